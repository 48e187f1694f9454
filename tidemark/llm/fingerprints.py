"""Document fingerprints by closed syncmers, with DataFrame functions only.

Words (lower case) are hashed; a k-mer of words is an anchor when the smallest of its inner s-mers stands at its first
or last place. Whether a k-mer is an anchor depends on its own words alone, so equal passages have equal anchors
wherever they stand. A fingerprint is all distinct anchor hashes, ascending, each with its first position (in words):
`hash:position` in hexadecimal, joined by spaces; it grows with the text. Likeness is the share of the anchors of both
texts together that both have, and `shift` the median difference of the positions of shared anchors. `size`, where
given, keeps the smallest hashes alone.

A text with fewer words than k is one anchor, and one without any closed syncmer takes all its k-mers. Null and empty
texts have an empty fingerprint; two empty fingerprints are alike (1.0), an empty one and another are not (0.0).

Order. Over a table of ids alone, sorted by range, every m-th key (id, hash of the text) starts a chunk; the driver gets
these keys, CHUNKS and a task's worth at most, and each row finds its chunk by binary search among them. A row that
starts a chunk goes to the chunk before it, too (the first of all: to the last), so that within chunks each row stands
before its next one. Texts are shuffled once, and each text's anchors are found once. Rows that share an id are ordered
by a hash of their texts; a null id comes first. Rows equal in both, where there are more of them than a chunk's share,
are one row with their number: each of them but the last is followed by its own text, the last by the next of the others.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, row_key, tasks_for, written

K, S = 5, 2
CHUNKS = 1 << 17  # at most, as the driver and all tasks hold their first keys
PER_TASK, COPIES = 8, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), GAP), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def anchors(text: Column, k: int = K, s: int = S, size: int | None = None) -> Column:
    """The fingerprint as array<struct<h bigint, p int>>."""

    def combined(h: Column, i: Column, n: int) -> Column:
        return F.xxhash64(*[F.get(h, i + j) for j in range(n)])

    def kmers(h: Column) -> Column:
        n = F.size(h)
        places = F.sequence(F.lit(0), n - k)

        def chosen(inner: Column) -> Column:
            width = k - s

            def edge(i: Column) -> Column:
                low = F.least(*[F.get(inner, i + j) for j in range(width + 1)])
                return (F.get(inner, i) == low) | (F.get(inner, i + width) == low)

            return let(F.filter(places, edge), lambda found: F.when(F.size(found) > 0, found).otherwise(places))

        inner = F.transform(F.sequence(F.lit(0), n - s), lambda i: combined(h, i, s))
        at = let(inner, chosen)
        some = F.transform(at, lambda i: F.struct(combined(h, i, k).alias("h"), i.alias("p")))
        whole = F.array(F.struct(F.xxhash64(F.concat_ws(",", F.transform(h, lambda x: x.cast("string")))).alias("h"), F.lit(0).alias("p")))
        none = F.array().cast("array<struct<h:bigint,p:int>>")
        return F.when(n == 0, none).when(n < k, whole).otherwise(some)

    def smallest(found: Column) -> Column:
        distinct = F.filter(found, lambda x, i: (i == 0) | (x["h"] != F.get(found, i - 1)["h"]))
        return distinct if size is None else F.slice(distinct, 1, size)

    return let(word_hashes(text), lambda h: let(F.sort_array(kmers(h)), smallest))


def shown(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat(F.lower(F.lpad(F.hex(x["h"]), 16, "0")), F.lit(":"), F.lower(F.hex(x["p"])))), " ")


def likeness(a: Column, b: Column) -> Column:
    x, y = F.transform(a, lambda v: v["h"]), F.transform(b, lambda v: v["h"])
    both = let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def shift(a: Column, b: Column) -> Column:
    """Median over shared anchors of the position in b less the position in a; null where none is shared."""

    def of(found: Column, side: int) -> Column:
        return F.transform(found, lambda v: F.struct(v["h"].alias("h"), F.lit(side).alias("side"), v["p"].alias("p")))

    def differences(v: Column) -> Column:  # equal hashes stand side by side, that of a first
        each = F.transform(v, lambda x, i: F.when((i > 0) & (F.get(v, i - 1)["h"] == x["h"]), x["p"] - F.get(v, i - 1)["p"]))
        return F.sort_array(F.filter(each, lambda d: d.isNotNull()))

    places = let(F.sort_array(F.concat(of(a, 0), of(b, 1))), differences)
    return let(places, lambda d: F.get(d, F.floor((F.size(d) - 1) / 2).cast("int")))


def fingerprint(docs: DataFrame, k: int = K, s: int = S, size: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, anchors and fingerprint of every row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).select("doc_id", anchors(F.col("text"), k, s, size).alias("anchors")).withColumn("fingerprint", shown(F.col("anchors")))


def starts_of(light: DataFrame, rows_each: int) -> list[tuple[int | None, int]]:
    """Ascending keys (id, mark), of every rows_each-th row of light."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("row_a")]
    placed = light.repartitionByRange(tasks_for(light), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    some = placed.where(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) % rows_each == 0).select("doc_id", "mark").distinct().collect()
    return sorted(((r.doc_id, r.mark) for r in some), key=lambda k: (k[0] is not None, k[0] or 0, k[1]))


def start_at(starts: list[tuple[int | None, int]], i: Column) -> Column:
    ids, marks = (F.from_json(F.lit(json.dumps([k[j] for k in starts])), "array<bigint>") for j in (0, 1))  # folded to constants
    return F.struct(F.get(ids, i).alias("doc_id"), F.get(marks, i).alias("mark"))


def chunk_of(starts: list[tuple[int | None, int]], key: Column) -> Column:
    """The last chunk whose first key is at most this one, by binary search; nulls come first, as in the order of structs."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(starts).bit_length()))])

    def step(at: Column, more: Column) -> Column:
        return F.when((at + more < len(starts)) & (start_at(starts, at + more) <= key), at + more).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def once_if_hot(marked: DataFrame, light: DataFrame, limit: int) -> DataFrame:
    """marked with copies; of rows with more than limit copies, one (there are fewer such rows than rows / limit)."""
    hot = light.where(F.col("copies") > limit).select("row_a", "row_b", "copies")
    if hot.isEmpty():
        return marked.withColumn("copies", F.lit(1).cast("long"))
    flagged = marked.join(F.broadcast(hot), ["row_a", "row_b"], "left").select(*marked.columns, "copies")
    first = Window.partitionBy("row_a", "row_b").orderBy("mark")
    single = flagged.where("copies is not null").withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    return flagged.where("copies is null").fillna(1, ["copies"]).unionByName(single)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (the last half replaced by the next document's start) and their likeness."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    marked = texts.withColumn("mark", F.xxhash64("text"))
    marked = marked.select("*", *row_key(marked, "doc_id", "mark"))
    light = written(marked.groupBy("row_a", "row_b").agg(F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"), F.count("*").alias("copies")), "order")
    size = light.agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")).first()
    chunks = min(CHUNKS, PER_TASK * tasks_for(docs))
    starts = starts_of(light, max(1, -(-size.rows // chunks))) or [(None, 0)]
    rows = once_if_hot(marked, light, max(COPIES, (size.copies or 0) // chunks))

    own = rows.withColumn("chunk", chunk_of(starts, F.struct("doc_id", "mark")))
    place = lambda chunk, guest: F.struct(chunk.alias("chunk"), F.lit(guest).alias("guest"))
    before = F.pmod(F.col("chunk") - 1, F.lit(len(starts)))
    starting = F.struct("doc_id", "mark") == start_at(starts, F.col("chunk"))
    places = F.when(starting, F.array(place(F.col("chunk"), 0), place(before, 1))).otherwise(F.array(place(F.col("chunk"), 0)))
    dealt = own.withColumn("p", F.explode(places)).select("doc_id", "text", "mark", "row_a", "copies", "p.chunk", "p.guest")
    parts = tasks_for(docs)
    dealt = dealt.withColumn("part", F.pmod("chunk", F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))
    order = [F.col("guest"), F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("row_a")]
    sorted_rows = dealt.sortWithinPartitions("part", "chunk", *order).withColumn("a", anchors(F.col("text")))
    following = Window.partitionBy("part", "chunk").orderBy(*order)
    full = sorted_rows.withColumns({"next_text": F.lead("text").over(following), "c": F.lead("a").over(following)}).where("guest = 0")
    last = F.struct(F.col("next_text").alias("next_text"), F.col("c").alias("c"), F.lit(1).cast("long").alias("times"))
    others = F.struct(F.col("text").alias("next_text"), F.col("a").alias("c"), (F.col("copies") - 1).alias("times"))
    followed = full.withColumn("f", F.explode(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last)))).select("doc_id", "text", "a", "f.next_text", "f.c", "f.times")
    n = F.length("text")
    start = F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 2)).cast("int"))
    edited = followed.select("doc_id", n.cast("long").alias("n_chars"), "a", "c", F.concat(start, F.substring(F.col("next_text"), F.lit(1), F.floor(n / 2).cast("int"))).alias("edited"), "times")
    found = edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", anchors(F.col("edited")).alias("b"), "c", "times")
    shown_rows = found.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("a")).alias("fingerprint"), shown(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), shift(F.col("a"), F.col("b")).alias("edited_shift"), "times",
    )
    return shown_rows.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
