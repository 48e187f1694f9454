"""Toxicity by nearest labelled examples: exact cosine of TF-IDF vectors over all words, by a block-max inverted index.

A term is a word in lower case without signs at its ends. All terms of the labelled examples are indexed. A term weighs
(1 + log of its count) * IDF * lean: the IDF is of all documents, and lean = 1 + G / 10, where G is the G-test of the
term against the labels, so that a word that goes with a label counts more but none is left out (lean 1 for all words
finds far fewer toxic texts; see README). A word that no example has has no coordinate: it would lengthen a text's
vector, which scales its cosines alike and changes no neighbour and no vote. Examples with equal counts are one entry of
the index, with counts of both labels.

Index. Entries that are alike stand side by side (spherical k-means) and are cut into blocks of BLOCK. For each term and
block the index keeps the block's largest weight. What rare terms give to a cosine is summed from their postings; what
frequent terms can give at most, from the block maxima. A few texts at a time score the blocks of their largest bounds,
and then all blocks whose bound reaches the k-th cosine found so far; no other block can hold a nearer entry. This is
done in single precision, less what that may lose, and what may be among the k nearest in double, so these are exact. Texts whose best blocks are the same are taken together; this and the clusters change speed alone.

Neighbours vote with weight cosine^4 times the root of their count; a logistic curve, fitted on leave-one-out votes,
turns votes into calibrated scores. Evidence: ids of the nearest examples.

At most max_examples labelled rows are indexed, chosen by a hash of the id (a documented bound); every row is scored
over its whole text. Null and empty texts, and texts without any word of an example, have no neighbours: their score is
that of a vote of 0. Without examples every score is 0. Repeated rows get equal scores; null ids are returned as they
are; unknown columns are ignored. Where labels of an id clash, it counts as toxic; where its texts do, the smallest is
the example.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

MAX_EXAMPLES = 8000
LEAN = 10.0
K, AT_ONCE, SORTED = 15, 64, 2048
FREQUENT = 1024  # terms with dense rows; for speed alone
BLOCK, CLUSTERS = 16, 128
SLACK = 1e-4  # more than single precision loses in a product of unit vectors
CACHE = 300_000
_EDGES = re.compile(r"^\W+|\W+$")
_SIGNS = bytes(c for c in range(33, 127) if not (chr(c).isalnum() or chr(c) == "_"))  # those of ASCII


def term_of(word: str) -> str:
    """A word in lower case without signs at its ends; empty if it has nothing else."""
    return (word if word.isalnum() else _EDGES.sub("", word)).lower()


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() splits at just the six white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def terms_of(text: str | None) -> set[str]:
    return {t for w in set(words_of(text)) if (t := term_of(w.decode("utf-8", "surrogatepass")))}


class Terms(dict):
    """Word -> index of its term, -1 where no example has it."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        plain = word.strip(_SIGNS)  # isalnum() is true for letters and digits of ASCII alone
        out = self.vocabulary.get(plain.lower().decode() if plain.isalnum() else term_of(word.decode("utf-8", "surrogatepass")), -1)
        if len(self) < CACHE and len(word) < 64:
            self[word] = out
        return out


def counted(text: str | None, terms: Terms) -> np.ndarray:
    """(term, count) of each term, ascending."""
    found = np.array([*map(terms.__getitem__, words_of(text))], np.int64)
    return np.column_stack(np.unique(found[found >= 0], return_counts=True))


def alike(matrix: np.ndarray, clusters: int = CLUSTERS, rounds: int = 8) -> np.ndarray:
    """An order of rows in which like rows stand side by side."""
    if len(matrix) <= clusters:
        return np.arange(len(matrix))
    centres = matrix[np.random.default_rng(0).choice(len(matrix), clusters, replace=False)]
    for _ in range(rounds):
        mine = (matrix @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, matrix)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return np.argsort(mine, kind="stable")


@dataclass
class Index:
    """Block-max inverted index of unit vectors. build() orders the entries anew."""

    vocabulary: dict[str, int]
    idf: np.ndarray  # times lean
    ids: np.ndarray  # of each entry, its smallest id
    n: np.ndarray
    positive: np.ndarray
    starts: np.ndarray = None  # of each term's postings
    docs: np.ndarray = None
    weights: np.ndarray = None
    frequent: np.ndarray = None  # terms with dense rows
    place: np.ndarray = None  # of each term among them, or -1
    edges: np.ndarray = None  # first entry of each block, and the end
    most: np.ndarray = None  # (blocks, frequent): largest weights
    dense: np.ndarray = field(default=None, repr=False)  # (entries, frequent), in single precision
    rows: tuple = field(default=None, repr=False)  # the same in double precision: starts of entries, places, weights
    curve: tuple[float, float] = (1.0, 0.0)

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        at, c = np.asarray(counts, np.int64).reshape(-1, 2).T
        w = (1 + np.log(c)) * self.idf[at]
        return at, w / max(np.sqrt((w * w).sum()), 1e-300)

    def build(self, entries: list) -> np.ndarray:
        """entries: counts of each. Gives the order that the entries, ids, n and positive now have."""
        vectors = [self.vector(c) for c in entries]
        terms = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in vectors)])
        df = np.bincount(terms, minlength=len(self.idf))
        self.frequent = np.argsort(-df, kind="stable")[:FREQUENT]
        self.frequent = self.frequent[df[self.frequent] > len(entries) / 64]
        self.place = np.full(len(self.idf), -1)
        self.place[self.frequent] = np.arange(len(self.frequent))
        order = alike(self._dense(vectors, np.float32))
        vectors = [vectors[i] for i in order]
        self.ids, self.n, self.positive = np.asarray(self.ids)[order], self.n[order], self.positive[order]
        terms = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in vectors)])
        by_term = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(at) for at, _ in vectors])[by_term]
        self.weights = np.concatenate([np.zeros(0), *(w for _, w in vectors)])[by_term]
        self.starts = np.concatenate([[0], np.cumsum(df)])
        self.edges = np.append(np.arange(0, len(vectors), BLOCK), len(vectors))
        self.most = np.maximum.reduceat(self._dense(vectors, np.float32), self.edges[:-1], axis=0) if len(vectors) else np.zeros((0, len(self.frequent)), np.float32)
        return order

    def _dense(self, vectors: list, kind=np.float64) -> np.ndarray:
        """(vectors, frequent terms)."""
        at, w = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in vectors)]), np.concatenate([np.zeros(0), *(x for _, x in vectors)])
        row = np.repeat(np.arange(len(vectors)), [len(x) for x, _ in vectors])
        place, out = self.place[at], np.zeros((len(vectors), len(self.frequent)), kind)
        out[row[place >= 0], place[place >= 0]] = w[place >= 0]
        return out

    def __getstate__(self):
        return self.__dict__ | {"dense": None, "rows": None}  # each worker fills its own

    def _filled(self) -> np.ndarray:
        if self.dense is None:
            n = self.starts[self.frequent + 1] - self.starts[self.frequent]
            posting = np.arange(n.sum()) + np.repeat(self.starts[self.frequent] - np.cumsum(n) + n, n)
            entry, place, w = self.docs[posting], np.repeat(np.arange(len(n), dtype=np.int32), n), self.weights[posting]
            self.dense = np.zeros((len(self.ids), len(n)), np.float32)
            self.dense[entry, place] = w
            order = np.argsort(entry, kind="stable")
            self.rows = np.concatenate([[0], np.cumsum(np.bincount(entry, minlength=len(self.ids)))]), place[order], w[order]
        return self.dense

    def _exact(self, left: np.ndarray, e: np.ndarray) -> np.ndarray:
        """What frequent terms give to the cosines of a text and some entries, in double precision."""
        starts, place, w = self.rows
        n = starts[e + 1] - starts[e]
        at = np.arange(n.sum()) + np.repeat(starts[e] - np.cumsum(n) + n, n)
        return np.bincount(np.repeat(np.arange(len(e)), n), left[place[at]] * w[at], len(e))

    def _rare(self, vectors: list) -> np.ndarray:
        """(texts, entries): what the other terms give to cosines."""
        at, w = np.concatenate([x for x, _ in vectors]), np.concatenate([x for _, x in vectors])
        row = np.repeat(np.arange(len(vectors)), [len(x) for x, _ in vectors])
        some, size = self.place[at] < 0, len(self.ids)
        at, w, row = at[some], w[some], row[some]
        n = self.starts[at + 1] - self.starts[at]
        posting = np.arange(n.sum()) + np.repeat(self.starts[at] - np.cumsum(n) + n, n)
        sums = np.bincount(np.repeat(row * size, n) + self.docs[posting], np.repeat(w, n) * self.weights[posting], len(vectors) * size)
        return sums.reshape(len(vectors), size)

    def home(self, some: list) -> np.ndarray:
        """The block of the largest bound by frequent terms, to take like texts together."""
        return (self._dense([self.vector(c) for c in some], np.float32) @ self.most.T).argmax(1)

    def nearest_of(self, some: list, k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """Exact: for each text (its counts), entries of the k largest cosines above 0 (ties: smallest ids), and these."""
        vectors, dense = [self.vector(c) for c in some], self._filled()
        left, rare = self._dense(vectors), self._rare(vectors)
        single = left.astype(np.float32)
        bound = single @ self.most.T + np.maximum.reduceat(rare, self.edges[:-1], axis=1)

        def screened(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            e = np.flatnonzero(np.repeat(blocks, np.diff(self.edges)))
            return e, single @ dense[e].T + rare[:, e]

        def least_of(s: np.ndarray) -> np.ndarray:
            """No entry with a cosine below these is among the k nearest."""
            n = s.shape[1]
            return np.partition(s, n - k, axis=1)[:, n - k] - 2 * SLACK if k < n else np.zeros(len(s))

        blocks = bound.shape[1]
        first, tops = np.zeros(blocks, bool), min(blocks, -(-k // BLOCK) + 3)
        first[np.argpartition(-bound, tops - 1, axis=1)[:, :tops]] = True
        e, s = screened(first)
        rest = (bound >= least_of(s)[:, None]) & (bound > 0)
        rest = rest.any(0) & ~first
        if rest.any():
            more, s_more = screened(rest)
            e, s = np.concatenate([e, more]), np.concatenate([s, s_more], axis=1)
        out = []
        for i, least in enumerate(least_of(s)):
            at = e[(s[i] >= least) & (s[i] > 0)]
            cosine = self._exact(left[i], at) + rare[i, at]
            order = np.lexsort((self.ids[at], -cosine.round(12)))[:k]
            out.append((at[order], cosine[order]))
        return out

    def nearest(self, counts, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([counts], k)[0]

    def vote(self, e: np.ndarray, s: np.ndarray, leave: int | None = None, label: int = 0) -> float:
        """Weighted share of label 1 among the nearest. leave: an entry of which one example, of this label, is left out."""
        n, p = self.n[e].astype(float), self.positive[e].astype(float)
        if leave is not None:
            n, p = n - (e == leave), p - (e == leave) * label
        w = s**4 * np.sqrt(n)
        return float((w * p / np.maximum(n, 1)).sum() / w.sum()) if w.sum() > 0 else 0.0

    def score(self, vote: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-40, min(40, a * vote + b))))


def fitted_curve(votes: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of labels on votes by Newton's method (Platt's smoothed targets); never falling."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    y = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.column_stack([votes, np.ones(len(votes))]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        g = x.T @ (p - y) + ridge * theta
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(1e-6, float(theta[0])), float(theta[1])


def _terms_task(batches):
    for batch in batches:
        found = [list(terms_of(text)) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["label", "terms"])


def vocabulary_of(examples: DataFrame, n_pos: int, n_neg: int) -> tuple[list[str], np.ndarray]:
    """All terms of the examples, ascending, and the lean of each."""
    counts = (
        examples.mapInArrow(_terms_task, "label int, terms array<string>")
        .select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("label").alias("p"), F.count("*").alias("n"))
        .toArrow()  # terms of max_examples texts
        .sort_by("term")
    )
    p, n = (counts.column(c).to_numpy().astype(float) for c in ("p", "n"))
    share = n_pos / (n_pos + n_neg)

    def part(seen: np.ndarray, share: float) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1) / np.maximum(n * share, 1e-300))

    g = 2 * (part(p, share) + part(n - p, 1 - share)) if n_pos and n_neg else np.zeros(len(n))
    return counts.column("term").to_pylist(), 1 + np.maximum(g, 0) / LEAN


def _frequencies_task(vocabulary: dict[str, int]):
    def task(batches):
        terms, n = Terms(vocabulary), np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = {*map(terms.__getitem__, set(words_of(text.as_py())))}
                found.discard(-1)
                n[list(found)] += 1
                n[-1] += 1  # documents
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["term", "n"])

    return task


def idf_of(texts: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """log(1 + documents / documents with the term), counted over all documents."""
    sums = texts.select("text").mapInArrow(_frequencies_task(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(vocabulary) + 1)
    n[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return np.log1p(n[-1] / np.maximum(n[:-1], 1))


def _counts_task(vocabulary: dict[str, int]):
    def task(batches):
        terms = Terms(vocabulary)
        for batch in batches:
            found = [counted(t, terms).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "counts"])

    return task


def build_index(docs: DataFrame, labelled: DataFrame, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> Index | None:
    """labelled: (doc_id, label 0/1); the caller has removed what mustn't be learnt from."""
    known = labelled.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    examples = written(texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxic-examples")
    sums = {r.label: r["count"] for r in examples.groupBy("label").count().collect()}
    n_pos, n_neg = sums.get(1, 0), sums.get(0, 0)
    if not n_pos + n_neg:
        return None
    chosen, lean = vocabulary_of(examples, n_pos, n_neg)
    vocabulary = {t: i for i, t in enumerate(chosen)}
    rows = examples.mapInArrow(_counts_task(vocabulary), "doc_id long, label int, counts binary").collect()  # max_examples rows
    rows.sort(key=lambda r: r.doc_id)
    entries: dict[bytes, list] = {}
    for r in rows:
        x = entries.setdefault(bytes(r.counts), [r.doc_id, 0, 0])
        x[1] += 1
        x[2] += r.label
    index = Index(vocabulary, idf_of(texts, vocabulary) * lean, np.array([x[0] for x in entries.values()]), np.array([x[1] for x in entries.values()]), np.array([x[2] for x in entries.values()]))
    vectors = [np.frombuffer(c, "<i4").reshape(-1, 2) for c in entries]
    order = index.build(vectors)
    vectors, found = [vectors[i] for i in order], list(entries)
    nearest = [x for i in range(0, len(vectors), AT_ONCE) for x in index.nearest_of(vectors[i : i + AT_ONCE])]
    position = {found[k]: i for i, k in enumerate(order)}
    own = [(position[bytes(r.counts)], r.label) for r in rows]
    index.curve = fitted_curve(np.array([index.vote(*nearest[i], i, y) for i, y in own]), np.array([y for _, y in own]))
    return index


def _score_task(index: Index | None):
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(pa.int64())), ("evidence_cosine", pa.list_(pa.float64()))])

    def scored(texts: pa.Array, terms: Terms) -> list[tuple]:
        counts = [counted(t, terms) for t in texts.to_pylist()]
        homes = np.concatenate([index.home(counts[i : i + AT_ONCE]) for i in range(0, len(counts), AT_ONCE)])
        order, found = np.argsort(homes, kind="stable"), [None] * len(counts)
        for i in range(0, len(counts), AT_ONCE):
            some = order[i : i + AT_ONCE].tolist()
            for at, (e, s) in zip(some, index.nearest_of([counts[j] for j in some]), strict=True):
                y = index.score(index.vote(e, s))
                found[at] = (y, int(y >= 0.5), index.ids[e[:5]], s[:5])
        return found

    def task(batches):
        terms = Terms(index.vocabulary) if index else None
        for whole in batches:
            for first in range(0, whole.num_rows, SORTED):
                batch = whole.slice(first, SORTED)
                rows = scored(batch.column(1), terms) if index else [(0.0, 0, [], [])] * batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((batch.column(0), *zip(*rows, strict=True)), out, strict=True)], schema=out)

    return task


def score_toxicity(docs: DataFrame, labelled: DataFrame, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, evidence and evidence_cosine of every row of docs."""
    index = build_index(docs, labelled, max_examples, id_col, text_col)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(_score_task(index), "doc_id long, score double, predicted int, evidence array<long>, evidence_cosine array<double>")
