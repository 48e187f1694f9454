"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Sources get weights by their place in code-point order (null last) and share the size of the whole corpus; no target
passes `epochs` times its source's size, and what a capped source leaves is shared again by weight (water filling, in
closed form over sources sorted by cap / weight). Within a source, every document draws an exponential key from a hash
of its id, divided by its quality weight; complete epochs take every document, and the rest of the target takes
documents in key order until their prefix sum comes nearest to it.

A source may hold any share of all rows: rows are range-partitioned by (source, key), so that a large source spans many
partitions, and prefix sums are added up over partitions. What moves holds no text. Only per-source and per-partition
sums meet in one task.

Null and empty texts have size 0 and are taken 0 words. A row with a null id draws its key from its text. Repeated rows
have equal keys and stand side by side; rows are never merged. An empty table gives no rows. Unknown columns are ignored
by mix; take returns them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, row_key, tasks_for, written

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 20_240_613


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A weight in [0.05, 1]: less for texts with many symbols, capitals and digits."""
    size = F.greatest(F.length(text), F.lit(1))
    odd = (F.length(text) - F.length(F.translate(text, "#*$%&|<>!0123456789", ""))) / size
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 4 * odd), F.lit(0.05))


def uniform(*cols: Column, seed: int = SEED) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target of every source. sizes: (source, source_size), one row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    order = Window.orderBy("ratio", "place")
    rows = (
        sizes.withColumn("place", place)
        .withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * epochs).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("capped", F.col("ratio") < F.col("level"))
        .withColumn("share", F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy()))
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS, quality: Column | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys: tuple = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the sampling key of every row, and what `keys` (row_key) gives."""
    text = docs[text_col].cast("string")
    weight = text_quality(text) if quality is None else quality
    own = docs[id_col].cast("long")
    key = -F.log(uniform(F.coalesce(own, F.xxhash64(text)), seed=seed)) / weight
    light = written(docs.select(own.alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(text).alias("size"), key.alias("key"), *keys), "sizes")
    carried = [c for c in light.columns if c in ("row_a", "row_b")]
    placed = written(light.repartitionByRange(tasks_for(docs), F.col("source").asc_nulls_last(), "key", "doc_id", "size").withColumn("part", F.spark_partition_id()), "mix")
    by_part = placed.groupBy("part", "source").agg(F.sum("size").alias("part_size"))
    targets = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    before = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_part.select("part", "source", before.alias("before"))
    inside = F.sum("size").over(Window.partitionBy("part", "source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    of = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.part", "o.source", "before", "source_size", "target")
    rows = placed.withColumn("inside", inside).alias("p").join(of.alias("f"), (F.col("p.part") == F.col("f.part")) & F.col("p.source").eqNullSafe(F.col("f.source")))
    size, total, target = F.col("size"), F.col("source_size"), F.col("target")
    full = F.when(total > 0, F.floor(target / total)).otherwise(0)
    rest = target - full * total
    more = (F.col("before") + F.col("inside") - size / 2 <= rest) & (rest > 0)
    return rows.select("doc_id", F.col("p.source").alias("source"), "size", "source_size", "target", (size * (full + F.when(more, 1).otherwise(0))).cast("long").alias("taken"), "key", *carried)


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them (mix's options). Rows are told apart by hashes of all they hold, so
    ids may repeat or be null."""
    times = mix(docs, keys=tuple(row_key(docs)), **options).where("taken > 0").groupBy("row_a", "row_b").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("row_times"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(docs)).dropDuplicates(["row_a", "row_b"])
    return rows.join(times, ["row_a", "row_b"]).select("row", F.explode(F.sequence(F.lit(1), "row_times"))).select(*[F.col(f"row.`{c}`") for c in docs.columns])
