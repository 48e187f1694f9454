"""Near duplicates by SuperMinHash: signatures, banding, verification on full sets, union-find grouping.

Signatures. Each shingle draws a permutation of the m slots (m prime, from the affine family) and a random fraction for
each rank; a slot keeps the smallest rank + fraction over all shingles. Ranks are drawn level by level, and a text
stops at the first level after which every slot is filled, since no later rank can be smaller.

Classes. Documents with equal shingle sets (128-bit digest of the sorted set) are one class, so large groups of copies
cost one node each. Bands of signature rows deal classes into buckets.

Links. In each bucket the smallest class is compared with all others (a star, not all pairs). Buckets that still hold
several groups after that are gone through with full sets, in blocks: pairs of different groups are compared, each pair
in the first of the bands that it shares, if lengths and 256-bit sketches of the signatures leave a chance of the
threshold (5 standard deviations below it). Only links come out, one for two groups that they join. Every link is
verified on full sets of shingle hashes (64 bit). Banding misses a pair at the threshold with probability 1e-6 for sets
of many shingles; for the smallest (four or five) about 2e-5, as their slots aren't independent. Nothing else is lost.

Groups. Tasks contract their links by union-find to star forests; large-star and small-star rounds then join these
across tasks, each round written to the shared folder. A node with very many links meets them by a broadcast of such
nodes alone, whose number is bounded (HOT_SHARE). Nothing is collected to the driver but counts.

Nulls and texts without words have an empty set and are linked with nothing. A text with fewer words than a shingle is
one shingle. A null doc_id is linked like others, but represents a group only if the group has no ids; component_id is
then null, and each such row with a null id counts as kept. keep_one keeps one row of each group whatever its ids are.
Rows are told apart by hashes of all they hold, so ids may repeat. An empty table gives an empty result. Unknown columns
are ignored by near_duplicates and kept by keep_one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, lowered, row_key, tasks_for, written

SLOTS = 257  # prime
MISS = 1e-6
WORDS_KEPT = 400_000
HOT_SHARE = 8  # a node is hot if it has more than 1 / (8 * shuffle partitions) of all links: so few can be
BLOCK_BYTES = 64 << 20
_A, _B, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows a band may have if a pair at the threshold is to be missed with MISS at most."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log(1 - threshold**rows))
        if bands * rows <= SLOTS - 1 and bands <= 40:
            return bands, rows
    return SLOTS - 1, 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Word -> 64-bit hash; bounded, so that a worker's memory doesn't grow with the input."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT and len(word) < 64:
            self[word] = h
        return h


def shingles(text: str | None, k: int, word_hash: WordHash) -> np.ndarray:
    """The set of hashed shingles of k words, ascending."""
    words = lowered(text).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hash.__getitem__, words), np.uint64, n)
    if n < k:
        out = np.array([n], np.uint64)
        for x in h:
            out = mixed(out + _G) ^ x
        return mixed(out)
    out = h[: n - k + 1]
    for j in range(1, k):
        out = mixed(out + _G) ^ h[j : n - k + 1 + j]
    return np.unique(mixed(out))


def signature(s: np.ndarray) -> np.ndarray:
    """SuperMinHash of a set: SLOTS values, rank in the high and fraction in the low 32 bits."""
    m = np.uint64(SLOTS)
    if len(s) <= 128:  # all ranks at once: (slot - start) / step mod m is the rank of a slot
        return _small(s)
    start, step = s % m, (s >> np.uint64(32)) % np.uint64(SLOTS - 1) + np.uint64(1)
    sig, at, level = np.full(SLOTS, _EMPTY), start.copy(), 0
    while True:
        value = (mixed(s + np.uint64((int(_G) * (level + 1)) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)) | np.uint64(level << 32)
        np.minimum.at(sig, at.astype(np.int64), value)
        level += 1
        if level == SLOTS or (sig >> np.uint64(32)).max() < level:
            return sig
        at = (at + step) % m


_INVERSE = np.array([0] + [pow(x, -1, SLOTS) for x in range(1, SLOTS)], np.int64)


def _small(s: np.ndarray) -> np.ndarray:
    start = (s % np.uint64(SLOTS)).astype(np.int64)
    step = ((s >> np.uint64(32)) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    rank = (((np.arange(SLOTS)[None, :] - start[:, None]) * _INVERSE[step][:, None]) % SLOTS).astype(np.uint64)
    least = rank.min(0)
    who = rank == least  # only the smallest rank can win
    i, slot = np.nonzero(who)
    sig = np.full(SLOTS, _EMPTY)
    value = (mixed(s[i] + _G * (rank[i, slot] + np.uint64(1))) >> np.uint64(32)) | (rank[i, slot] << np.uint64(32))
    np.minimum.at(sig, slot, value)
    return sig


def _sign_task(k: int, bands: int, rows: int):
    out = pa.schema([("doc_id", pa.int64()), ("row_a", pa.int64()), ("row_b", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def task(batches):
        words = WordHash()
        for batch in batches:
            n_set, node, band, sketch = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), k, words)
                n_set.append(len(s))
                if not len(s):
                    node.append(None), band.append(None), sketch.append(None)
                    continue
                node.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig = signature(s)
                keys = np.arange(1, bands + 1, dtype=np.uint64)
                table = sig[: bands * rows].reshape(bands, rows)
                for j in range(rows):
                    keys = mixed(keys * _G ^ table[:, j])
                band.append(keys.view(np.int64))
                sketch.append(np.packbits((mixed(sig[: SLOTS - 1]) & np.uint64(1)).astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((batch.column(0), batch.column(2), batch.column(3), n_set, node, band, sketch), out, strict=True)], schema=out)

    return task


def _sets_task(k: int):
    """(text, node) -> (node, set)."""

    def task(batches):
        words = WordHash()
        for batch in batches:
            nodes, sets = [], []
            for text, node in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                nodes.append(node)
                sets.append(shingles(text.as_py(), k, words).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "set"])

    return task


def _verify_task(percent: int):
    """Pairs of sets with 100 * intersection >= percent * union."""

    def task(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return task


def _forest_task(batches):
    """Union-find over a task's links: each node with the smallest of its group."""
    root: dict[bytes, bytes] = {}

    def find(x):
        top = x
        while (y := root.get(top, top)) != top:
            top = y
        while (y := root.get(x, x)) != top:
            root[x], x = top, y
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > 200_000:  # bounded memory: what is known so far goes on as links
            yield _links(root, find)
            root = {}
    yield _links(root, find)


def _links(root, find):
    nodes = list(root)
    return pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.binary()), pa.array(nodes, pa.binary())], names=["a", "b"])


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)): how many sketch bits agree."""
    out = np.full((len(a), len(b)), 64 * a.shape[1], np.int16)
    for k in range(a.shape[1]):
        out -= np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


class Groups:
    """Union-find over numbers."""

    def __init__(self, label: np.ndarray):
        self.up = label.copy()

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def all(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def missing_links(comps: list[bytes], sets: list[np.ndarray], sketch: np.ndarray, bands: np.ndarray, block: np.ndarray, percent: int, least_bits: int, here: int) -> list[tuple[int, int]]:
    """Links between members of different groups, by their full sets; one is enough to join two groups. All have the band
    `here`; pairs that share an earlier one are left to it.

    block: 0 or 1 for each member; with both present only pairs across are looked at."""
    _, group = np.unique(np.array(comps, object).astype(bytes), return_inverse=True)
    first = np.full(group.max() + 1, -1)
    for i in range(len(group) - 1, -1, -1):
        first[group[i]] = i
    groups, across = Groups(first[group]), len(np.unique(block)) > 1
    size = np.array([len(x) for x in sets], np.int64)
    minor = np.flatnonzero(group != np.bincount(group).argmax())  # every pair across groups has one of these
    out = []
    for u in minor.tolist():
        label = groups.all()
        other = label != label[u]
        if across:
            other &= block != block[u]
        v = np.flatnonzero(other)
        v = v[100 * np.minimum(size[v], size[u]) >= percent * np.maximum(size[v], size[u])]
        v = v[_agreement(sketch[u : u + 1], sketch[v])[0] >= least_bits] if len(v) else v
        shared = bands[v] == bands[u]
        v = v[bands[u][shared.argmax(1)] == here] if len(v) else v
        if not len(v):
            continue
        flat = np.concatenate([sets[i] for i in v.tolist()])
        at = np.minimum(np.searchsorted(sets[u], flat), size[u] - 1)
        both = np.add.reduceat((sets[u][at] == flat).astype(np.int64), np.cumsum(size[v]) - size[v])
        for i in v[100 * both >= percent * (size[u] + size[v] - both)].tolist():
            if groups.find(i) != groups.find(u):
                groups.join(i, u)
                out.append((i, u))
    return out


def _bucket_task(percent: int, least_bits: int):
    """Rows (band, i, j, side, node, comp, sketch, bands, set), sorted by the first three -> links that were missing."""

    def links(rows: list) -> list[tuple]:
        if len({r[5] for r in rows}) < 2:
            return []
        array = lambda k: np.array([r[k] for r in rows], np.int64)
        sets = [np.frombuffer(r[8], np.uint64) for r in rows]
        found = missing_links([r[5] for r in rows], sets, array(6).view(np.uint64), array(7), array(3), percent, least_bits, rows[0][0])
        return [(min(rows[i][4], rows[j][4]), max(rows[i][4], rows[j][4])) for i, j in found]

    def task(batches):
        now, rows = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != now:
                    out += links(rows)
                    now, rows = row[:3], []
                rows.append(row)
            if out:
                yield batch_of(out)
        if out := links(rows):
            yield batch_of(out)

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], names=["a", "b"])

    return task


def with_least(links: DataFrame, by: str, value: str, total: int) -> DataFrame:
    """links with `low`, the smallest value of all links of the same `by`; hot nodes don't gather in one task."""
    least = links.groupBy(by).agg(F.min(value).alias("low"), F.count("*").alias("degree"))
    limit = max(64, total // (HOT_SHARE * tasks_for(links)))
    hot = F.broadcast(least.where(F.col("degree") > limit).drop("degree"))  # HOT_SHARE * partitions rows at most
    cold = least.where(F.col("degree") <= limit).drop("degree")
    return links.join(hot, by).unionByName(links.join(hot.select(by), by, "left_anti").join(cold, by))


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, comp) of every node in links (a, b), a < b: comp is the smallest node reachable. Large-star, small-star.

    rounds: stop after so many; then comp is some node of the same group."""
    scratch = Scratch(links.sparkSession)
    edges = written(links.mapInArrow(_forest_task, "a binary, b binary").dropDuplicates(), "links", scratch)

    def mark(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    done, now = 0, mark(edges)
    while True:
        # large star: each node links its larger neighbours to its smallest neighbour (itself included)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = with_least(both, "u", "v", 2 * now.n).withColumn("low", F.least("u", "low"))
        large = low.where(F.col("v") > F.col("u")).select(F.col("low").alias("a"), F.col("v").alias("b")).where("a != b").dropDuplicates()
        large = written(large, "links", scratch)
        # small star: each node links its smaller neighbours, and itself, to the smallest
        small = with_least(large, "b", "a", now.n).select("low", F.explode(F.array("a", "b")).alias("b")).select(F.col("low").alias("a"), "b").where("a != b").dropDuplicates()
        after, done = written(small, "links", scratch), done + 1
        if done == rounds:
            least = written(after.groupBy("b").agg(F.min("a").alias("comp")).withColumnRenamed("b", "node"), "comps")
            scratch.drop()
            return least
        then = mark(after)
        scratch.drop(1)
        if then == now:
            break
        edges, now = after, then
    out = written(after.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(after.select(F.col("a").alias("node"), F.col("a").alias("comp"))).dropDuplicates(), "comps")
    scratch.drop()
    return out


def _grouped(docs: DataFrame, k: int, percent: int, block_bytes: int, id_col: str, text_col: str, keys: list) -> tuple[DataFrame, DataFrame]:
    """signed: doc_id, row_a, row_b, n_shingles and node of every row; owner: of each node its comp, and the first row of those that have it."""
    scratch = Scratch(docs.sparkSession)
    bands, rows = bands_for(percent / 100)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *keys)
    signed = written(texts.mapInArrow(_sign_task(k, bands, rows), "doc_id long, row_a long, row_b long, n_shingles long, node binary, bands array<long>, sketch array<long>"), "signed")
    full = signed.where(F.col("node").isNotNull())
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_a", "row_b", "n_shingles", "bands", "sketch")).alias("best")
    nodes = written(full.groupBy("node").agg(best).select("node", *[f"best.{c}" for c in ("doc_id", "row_a", "row_b", "n_shingles", "bands", "sketch")]), "nodes")
    in_band = nodes.select(F.explode("bands").alias("band"), "node")
    stars = in_band.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = written(in_band.join(stars, "band").select("band", "lead", "node"), "buckets", scratch)

    pairs = written(members.where("lead < node").select(F.col("lead").alias("a"), F.col("node").alias("b")).dropDuplicates(), "pairs", scratch)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).dropDuplicates()
    ids = nodes.join(wanted, "node").select("row_a", "row_b", "node")
    sets = texts.join(ids, ["row_a", "row_b"]).select("text", "node").mapInArrow(_sets_task(k), "node binary, set binary")
    sets = written(sets.dropDuplicates(["node"]), "sets", scratch)
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    checked = pairs.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b").mapInArrow(_verify_task(percent), "a binary, b binary, linked boolean")
    links = written(checked.where("linked").select("a", "b"), "star-links", scratch)

    # buckets that are still in several groups: all pairs across groups, block by block
    p = (1 + percent / 100) / 2  # 256 sketch bits agree with probability (1 + J) / 2
    least_bits = math.floor(256 * p - 5 * math.sqrt(256 * p * (1 - p)))
    comp = components(links, 2)  # a group may still be in parts, which only costs comparisons
    placed = members.select("band", "node").join(nodes.select("node", "n_shingles"), "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = written(placed, "placed", scratch)
    spread = placed.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size"), F.sum("n_shingles").alias("shingles")).where("c0 != c1 AND size > 2")
    blocks = F.ceil((F.col("shingles") * 8 + F.col("size") * 600) / block_bytes).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    apart = placed.join(spread.select("band", blocks.alias("blocks")), "band").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    apart = apart.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "comp")
    full_rows = apart.join(nodes.select("node", "sketch", "bands"), "node").join(sets, "node").select("band", "i", "j", "side", "node", "comp", "sketch", "bands", "set")
    more = full_rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_bucket_task(percent, least_bits), "a binary, b binary")
    more = written(more, "bucket-links", scratch)  # else the next Python function would stand in the same stage, with workers of its own
    comp = components(links.union(more))
    scratch.drop()
    owner = nodes.select("node", "doc_id", "row_a", "row_b").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return signed.select("doc_id", "row_a", "row_b", "n_shingles", "node"), owner


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of every row."""
    signed, owner = _grouped(docs, k, percent, block_bytes, id_col, text_col, row_key(docs, id_col, text_col))
    heads = owner.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_node = owner.join(heads, "comp").select("node", "component_id")
    out = signed.join(of_node, "node", "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id (null last; of equal ids that of the smallest hash).
    Rows without words stay, equal ones once."""
    signed, owner = _grouped(docs, k, percent, block_bytes, id_col, text_col, row_key(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_a", "row_b")).alias("first")
    heads = owner.groupBy("comp").agg(first).select("first.row_a", "first.row_b")
    stay = heads.union(signed.where(F.col("node").isNull()).select("row_a", "row_b"))
    rows = docs.select("*", *row_key(docs))
    return rows.join(stay, ["row_a", "row_b"], "left_semi").dropDuplicates(["row_a", "row_b"]).select(*[F.col(f"`{c}`") for c in docs.columns])
