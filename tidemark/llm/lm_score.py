"""LM scoring by prediction by partial matching (PPM) over bytes, with escape estimation and symbol exclusion.

The model is a context trie of order ORDER, learnt from all training documents: for each context of up to ORDER bytes,
how often each byte followed. A byte is coded in the longest context seen; a context with n observations of d symbols
gives symbol s the probability c(s) / (n + d) and escapes to the next shorter one with d / (n + d) (method C), where
symbols of the longer context are excluded from n and d. Below order 0 all bytes are alike. Texts are lower-cased (A-Z),
begin in a context of start bytes (0xFE) and finish with an end byte (0xFF); neither occurs in UTF-8.

The probability of a byte depends on its (ORDER + 1)-gram alone, so grams are scored, not positions. Documents are
dealt into chunks; each chunk reports its distinct grams with training counts, packed into sorted arrays and dealt into
buckets by the two last bytes of context. A bucket's grams hold all its contexts of order 2 and more (orders 1 and 0
are a table of 256 x 256 counts), so its task can merge counts, score every gram and answer each chunk. A second
pass over the chunks adds up the answers. Words of the unigram base model are counted and answered in the same way.
Thus no task holds more than a chunk's or a bucket's grams, and nothing of the model but 65,536 sums meets the driver.

A null or empty text is its end symbol alone. A null id counts as the text "" for the split. Repeated rows are counted
and scored each. Without training documents all bytes are alike. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lowered, tasks_for, written

ORDER = 4
PAD, END = 0xFE, 0xFF
HELD_OUT = 10
BYTES_AT_ONCE = 1 << 20
BUCKETS_AT_MOST = 4096
GRAMS, WORDS, TOTALS, TEXT = 0, 1, 2, 3
_ONE = np.uint64(1)


def buffer_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts, a place for each byte of the buffer, and where each text begins in it."""
    pad, end = bytes([PAD]) * ORDER, bytes([END])
    data = b"\0" * 7 + b"".join([x for t in texts for x in (pad, t, end)])
    n = len(data) - 7
    grams = np.empty(n, np.uint64)
    for phase in range(8):  # eight bytes up to each place, the last byte lowest
        view = np.frombuffer(data, ">u8", (len(data) - phase) // 8, phase)
        grams[phase::8] = view[: len(grams[phase::8])]
    grams &= np.uint64((1 << 8 * (ORDER + 1)) - 1)
    sizes = np.fromiter((len(t) + ORDER + 1 for t in texts), np.int64, len(texts))
    return grams, np.cumsum(sizes) - sizes


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams that predict a byte (not a start byte), with their counts."""
    s = np.sort(grams)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    keys, counts = s[first], np.diff(np.r_[first, len(s)])
    good = (keys & np.uint64(0xFF)) != PAD
    return keys[good], counts[good]


class Chunk:
    """Distinct grams and words of one chunk, with training counts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.waiting: dict[bool, list[bytes]] = {True: [], False: []}
        self.bytes_waiting = 0
        self.words: Counter = Counter()

    def add(self, text: bytes, train: bool) -> None:
        words = text.split()
        if train:
            self.words.update(words)
        else:
            for w in words:
                self.words.setdefault(w, 0)
        self.waiting[train].append(text)
        self.bytes_waiting += len(text)
        if self.bytes_waiting > BYTES_AT_ONCE:
            self.flush()

    def flush(self) -> None:
        for train, texts in self.waiting.items():
            if texts:
                keys, counts = distinct(buffer_of(texts)[0])
                self.parts.append((keys, counts if train else np.zeros(len(keys), np.int64)))
                self.size += len(keys)
        self.waiting, self.bytes_waiting = {True: [], False: []}, 0
        if self.size > 4_000_000 and len(self.parts) > 1:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            self.parts = [summed(np.concatenate([k for k, _ in self.parts] or [np.zeros(0, np.uint64)]), np.concatenate([c for _, c in self.parts] or [np.zeros(0, np.int64)]))]
            self.size = len(self.parts[0][0])
        return self.parts[0]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    context = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return (((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


class _Rows:
    def __init__(self, fields):
        self.schema, self.rows = pa.schema(fields), []

    def batch(self):
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows = []
        return out


_REQUEST = [("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
REQUEST = "bucket int, chunk int, kind int, keys binary, counts binary"


def _requests(chunk: int, found: Chunk, buckets: int):
    found.flush()
    keys, counts = found.merged()
    b = bucket_of(keys, buckets)
    order = np.argsort(b, kind="stable")
    keys, counts, b = keys[order], counts[order].astype("<i8"), b[order]
    for one in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1):
        if len(one):
            yield int(b[one[0]]), chunk, GRAMS, keys[one].tobytes(), counts[one].tobytes()
    words: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in found.words:
        words[zlib.crc32(w) % buckets].append(w)
    for i, some in enumerate(words):
        if some:
            yield i, chunk, WORDS, b" ".join(some), np.fromiter(map(found.words.__getitem__, some), "<i8", len(some)).tobytes()


def _count_task(buckets: int):
    """(chunk, train, text) -> requests. Rows of a chunk lie in one task; several chunks may."""

    def task(batches):
        chunks: dict[int, Chunk] = {}
        for batch in batches:
            for chunk, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                chunks.setdefault(chunk, Chunk()).add(lowered(text.as_py()), train)
        for chunk in list(chunks):
            rows = _Rows(_REQUEST)
            rows.rows = list(_requests(chunk, chunks.pop(chunk), buckets))
            if rows.rows:
                yield rows.batch()

    return task


def _bigram_task(batches):
    """Training counts of pairs of bytes, one dense array per task."""
    total = np.zeros(65536, np.int64)
    for batch in batches:
        texts, size = [], 0
        for text in [*batch.column(0), None]:
            if text is not None:
                texts.append(lowered(text.as_py()))
                size += len(texts[-1])
            if texts and (text is None or size > BYTES_AT_ONCE):
                grams = buffer_of(texts)[0] & np.uint64(0xFFFF)
                total += np.bincount(grams.astype(np.int64), minlength=65536)
                texts, size = [], 0
    total[np.arange(256) * 256 + PAD] = 0
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["counts"])


def _sum_task(batches):
    total = np.zeros(65536, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(x.as_buffer(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["counts"])


def gram_scores(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 P of each gram's last byte after its context. keys: distinct, ascending; counts: in training;
    pairs: (256, 256) training counts of byte after byte."""
    known = counts > 0
    model, weight = keys[known], counts[known]
    single = pairs.sum(0)
    levels = []  # by order: contexts, n, d, x (observations of its symbols one order below); table keys and counts
    table, amount = model, weight
    for order in range(ORDER, 1, -1):
        if order < ORDER:
            table, amount = summed(table & np.uint64((1 << 8 * (order + 1)) - 1), amount)
        context = table >> np.uint64(8)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
        n = np.add.reduceat(amount, first) if len(first) else np.zeros(0, np.int64)
        d = np.diff(np.r_[first, len(table)]) if len(first) else np.zeros(0, np.int64)
        levels.append([order, context[first], n, d, first, table, amount])
    below = [lv[5:7] for lv in levels[1:]] + [None]
    for lv, under in zip(levels, below, strict=True):
        order, _, n, _, first, table, _ = lv
        if under is None:  # order 1 is the dense table
            got = pairs[(table >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64), (table & np.uint64(0xFF)).astype(np.int64)]
        else:
            got = under[1][np.searchsorted(under[0], table & np.uint64((1 << 8 * order) - 1))]
        lv[4] = np.add.reduceat(got, first) if len(first) else n
    out, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
    x, d_above = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # excluded by the longer context

    def visit(seen, n, d, c, x_here):
        nonlocal x, d_above
        n_left, d_left = n - x, d - d_above
        live = seen & ~done & (d_left > 0)
        total = np.where(live, n_left + d_left, 1)
        hit = live & (c > 0)
        out[hit] += np.log10(c[hit] / total[hit])
        miss = live & ~hit
        out[miss] += np.log10(d_left[miss] / total[miss])
        done[hit] = True
        x, d_above = np.where(seen, x_here, x), np.where(seen, d, d_above)

    for order, context, n, d, x_below, table, amount in levels:
        want = keys & np.uint64((1 << 8 * (order + 1)) - 1)
        if not len(context):
            continue
        at = np.minimum(np.searchsorted(context, want >> np.uint64(8)), len(context) - 1)
        seen = context[at] == want >> np.uint64(8)
        row = np.minimum(np.searchsorted(table, want), len(table) - 1)
        c = np.where(table[row] == want, amount[row], 0)
        visit(seen, n[at], d[at], c, x_below[at])
    last, symbol = (keys >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64), (keys & np.uint64(0xFF)).astype(np.int64)
    n1, d1, x1 = pairs.sum(1), (pairs > 0).sum(1), ((pairs > 0) * single[None, :]).sum(1)
    visit(n1[last] > 0, n1[last], d1[last], pairs[last, symbol], x1[last])
    n0, d0 = single.sum(), (single > 0).sum()
    everywhere = np.ones(len(keys), bool)
    if n0:
        visit(everywhere, np.full(len(keys), n0), np.full(len(keys), d0), single[symbol], np.zeros(len(keys), np.int64))
    out[~done] += -np.log10(max(1, 256 - d0))
    return out


_ANSWER = [("chunk", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())]
ANSWER = "chunk int, kind int, keys binary, vals binary"


def _answer_task(pairs: bytes):
    """Rows of a bucket, sorted by (bucket, kind): merge, score, answer each chunk."""

    def task(batches):
        table = np.frombuffer(pairs, "<i8").reshape(256, 256).astype(np.int64)
        held, now = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row[0], row[2]) != now:
                    yield from answered(now, held, table)
                    held, now = [], (row[0], row[2])
                held.append(row)
        yield from answered(now, held, table)

    def answered(now, held, table):
        if not held:
            return
        rows = _Rows(_ANSWER)
        if now[1] == GRAMS:
            parts = [(np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")) for *_, k, c in held]
            keys, counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            value = gram_scores(keys, counts, table).astype("<f4")
            for (_, chunk, kind, k, _), (own, _) in zip(held, parts, strict=True):
                rows.rows.append((chunk, kind, k, value[np.searchsorted(keys, own)].tobytes()))
        else:
            total: dict[bytes, int] = {}
            lists = [k.split(b" ") for *_, k, _ in held]
            for words, (*_, c) in zip(lists, held, strict=True):
                for w, n in zip(words, np.frombuffer(c, "<i8").tolist(), strict=True):
                    total[w] = total.get(w, 0) + n
            for words, (_, chunk, kind, k, _) in zip(lists, held, strict=True):
                rows.rows.append((chunk, kind, k, np.fromiter(map(total.__getitem__, words), "<i8", len(words)).tobytes()))
            seen = [n for n in total.values() if n]
            rows.rows.append((-1, TOTALS, b"", np.array([sum(seen), len(seen)], "<i8").tobytes()))
        yield rows.batch()

    return task


class GramTable:
    """Gram -> value by hashing in numpy: each level holds what the one before had no free place for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        rng = np.random.default_rng(7)
        while len(keys):
            bits = max(8, int(np.ceil(np.log2(len(keys)))) + 2)
            factor, shift = np.uint64(rng.integers(1 << 62) * 2 + 1), np.uint64(64 - bits)
            at = ((keys * factor) >> shift).astype(np.int64)
            slot_key, slot_value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)
            slot_key[at], slot_value[at] = keys, values  # the last of several stays
            self.levels.append((factor, shift, slot_key, slot_value))
            lost = slot_key[at] != keys
            keys, values = keys[lost], values[lost]

    def look_up(self, grams: np.ndarray) -> np.ndarray:
        """0 for grams that aren't there (those of start bytes)."""
        out, rest = np.zeros(len(grams)), None
        for factor, shift, slot_key, slot_value in self.levels:
            some = grams if rest is None else grams[rest]
            at = (some * factor) >> shift
            hit = slot_key[at] == some
            if rest is None:
                out = np.where(hit, slot_value[at], 0.0)
                rest = np.flatnonzero(~hit & ((some & np.uint64(0xFF)) != PAD))
            else:
                out[rest[hit]] = slot_value[at[hit]]
                rest = rest[~hit]
            if not len(rest):
                break
        return out


_SCORE = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())]
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _score_task(n_words: int, distinct_words: int, train_docs: int):
    """Rows sorted by (chunk, kind): a chunk's answers come before its texts."""
    n, v = n_words + train_docs, distinct_words + (train_docs > 0)
    bottom = np.log10(n + 0.1 * (v + 1))

    def task(batches):
        now, grams, values, words, table = None, [], [], {}, None
        rows, waiting, size = _Rows(_SCORE), [], 0

        def flush():
            texts = [t for *_, t in waiting]
            all_grams, starts = buffer_of(texts)
            scores = np.add.reduceat(table.look_up(all_grams), starts)
            for (doc, train, text), score in zip(waiting, scores.tolist(), strict=True):
                counts = np.fromiter(map(words.__getitem__, text.split()), np.int64)
                counts = np.append(counts, train_docs)
                base = float(np.log10(counts + 0.1).sum() - len(counts) * bottom)
                rows.rows.append((doc, not train, len(counts), int((counts > 0).sum()), n, base, score, len(text)))
            waiting.clear()
            return rows.batch()

        for batch in batches:
            for chunk, kind, keys, vals, doc, train, text in zip(*(batch.column(i) if i in (2, 3, 6) else batch.column(i).to_pylist() for i in range(7)), strict=True):
                if chunk != now:
                    if waiting:
                        yield flush()
                    now, grams, values, words, table, size = chunk, [], [], {}, None, 0
                if kind == GRAMS:
                    grams.append(np.frombuffer(keys.as_buffer(), "<u8").copy())
                    values.append(np.frombuffer(vals.as_buffer(), "<f4").astype(np.float64))
                elif kind == WORDS:
                    words.update(zip(keys.as_py().split(b" "), np.frombuffer(vals.as_buffer(), "<i8").tolist(), strict=True))
                else:
                    if table is None:
                        table = GramTable(np.concatenate(grams), np.concatenate(values))
                        grams, values = [], []
                    waiting.append((doc, train, lowered(text.as_py())))
                    size += len(waiting[-1][-1])
                    if size > BYTES_AT_ONCE:
                        yield flush()
                        size = 0
        if waiting:
            yield flush()

    return task


def score_documents(docs: DataFrame, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes of every row.

    score is the model's log10 probability of the text and its end; base_score that of the unigram model of words."""
    tasks = tasks_for(docs)
    buckets = min(tasks, BUCKETS_AT_MOST)
    split = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % held_out != 0
    texts = (
        docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
        .withColumn("train", split)
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(tasks)).cast("int"))
    )
    sums = texts.where("train").select("text").mapInArrow(_bigram_task, "counts binary").repartition(8).mapInArrow(_sum_task, "counts binary").collect()  # 8 arrays
    pairs = sum((np.frombuffer(r.counts, "<i8") for r in sums), np.zeros(65536, np.int64))
    train_docs = texts.where("train").count()
    requests = texts.select("chunk", "train", "text").repartitionById(tasks, "chunk").select("chunk", "train", "text").mapInArrow(_count_task(buckets), REQUEST)
    answers = written(requests.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer_task(pairs.astype("<i8").tobytes()), ANSWER), "answers")
    totals = answers.where(F.col("kind") == TOTALS).select("vals").mapInArrow(_totals_task, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    none = lambda kind: F.lit(None).cast(kind)
    both = (
        answers.where(F.col("kind") != TOTALS)
        .select("chunk", "kind", "keys", "vals", none("long").alias("doc_id"), none("boolean").alias("train"), none("string").alias("text"))
        .union(texts.select("chunk", F.lit(TEXT).alias("kind"), none("binary").alias("keys"), none("binary").alias("vals"), "doc_id", "train", "text"))
    )
    return both.repartitionById(tasks, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_score_task(totals.n or 0, totals.v or 0, train_docs), SCORE)


def _totals_task(batches):
    for batch in batches:
        x = np.array([np.frombuffer(v.as_buffer(), "<i8") for v in batch.column(0)], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["n", "v"])
