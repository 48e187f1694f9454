"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are the mean over its words of hashed one-hot vectors (the lower-case word and its shape), and a few
dense measures (repetition, symbols, capitals, digits, length). One weight vector is shared by all grades; ordered
thresholds t_0 < t_1 < ... cut the latent score: P(grade <= k) = sigmoid(t_k - score). From these come the expected
grade and the tail probability P(grade >= keep_from), which decides.

Fitting uses at most max_train labelled rows, chosen by a hash of the id (a documented bound); every row is scored.
Null and empty texts have no words: their hashed features are zero and only thresholds and dense features speak; they
are scored like any other. Null ids are returned as they are. With no labels, or labels of one grade only, the model
keeps everything. Repeated rows get equal scores. Unknown columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from operator import eq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 15
SIZE = 1 << BITS
MAX_TRAIN = 4000
CACHE = 400_000
N_DENSE = 7
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = b"#*$%&|<>!~^=_@{}[]\\/+"
_KIND = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def slots(word: bytes) -> tuple[int, int]:
    """The two hashed features of a word: itself in lower case, and its shape (runs of a kind of character as one)."""
    shape = _RUN.sub(rb"\1", word.translate(_KIND))
    return zlib.crc32(b"w" + word.lower()) & (SIZE - 1), zlib.crc32(b"s" + shape[:12]) & (SIZE - 1)


def dense(data: bytes, words: list[bytes]) -> tuple:
    n, chars = max(1, len(words)), max(1, len(data))
    gone = lambda x: (len(data) - len(data.translate(None, x))) / chars
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        sum(map(eq, words, words[1:])) / n, 1 - len(set(words)) / n, gone(_SYMBOLS), gone(_UPPER), gone(b"0123456789"),
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n) / 10,
    )


@dataclass
class OrdinalModel:
    weights: np.ndarray  # hashed features
    dense_weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each k but the last."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(grades: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, extra: np.ndarray, n_grades: int, steps: int = 250, l2: float = 1e-6, rate: float = 0.05) -> OrdinalModel:
    """Maximum likelihood by Adam. rows, cols, values: the sparse matrix of hashed features."""
    n = len(grades)
    centre, scale = extra.mean(0), extra.std(0) + 1e-6
    z = np.clip((extra - centre) / scale, -5, 5)
    share = np.array([(grades <= k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    gap = np.log(np.maximum(np.diff(first), 1e-2))
    p = [np.zeros(SIZE), np.zeros(z.shape[1]), first[:1].copy(), gap]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        cuts = np.concatenate([p[2], p[2][0] + np.cumsum(np.exp(p[3]))])
        score = np.bincount(rows, weights=p[0][cols] * values, minlength=n) + z @ p[1]
        upper = np.where(grades < n_grades - 1, sig(cuts[np.minimum(grades, n_grades - 2)] - score), 1.0)
        lower = np.where(grades > 0, sig(cuts[np.maximum(grades - 1, 0)] - score), 0.0)
        like = np.maximum(upper - lower, 1e-9)
        du = np.where(grades < n_grades - 1, upper * (1 - upper), 0) / like
        dl = np.where(grades > 0, lower * (1 - lower), 0) / like
        d_score = (du - dl) / n  # of the negative log likelihood
        d_cut = np.zeros(n_grades - 1)
        np.add.at(d_cut, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -du, 0) / n)
        np.add.at(d_cut, np.maximum(grades - 1, 0), np.where(grades > 0, dl, 0) / n)
        tail = np.cumsum(d_cut[::-1])[::-1]
        g = [np.bincount(cols, weights=d_score[rows] * values, minlength=SIZE) + l2 * p[0], z.T @ d_score + l2 * p[1], tail[:1], tail[1:] * np.exp(p[3])]
        for i in range(4):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    cuts = np.concatenate([p[2], p[2][0] + np.cumsum(np.exp(p[3]))])
    return OrdinalModel(p[0].astype(np.float32), p[1], centre, scale, cuts)


def _features_task(batches):
    out = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("cols", pa.list_(pa.int32())), ("vals", pa.list_(pa.float32())), ("extra", pa.list_(pa.float64()))])
    for batch in batches:
        found: list[list] = [[], [], [], [], []]
        for i, g, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            words = data.split()
            flat = np.array([x for w in words for x in slots(w)], np.int32)
            cols, counts = np.unique(flat, return_counts=True)
            for into, x in zip(found, (i, g, cols, (counts / max(1, len(words))).astype(np.float32), dense(data, words)), strict=True):
                into.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, out, strict=True)], schema=out)


def train(docs: DataFrame, graded: DataFrame, n_grades: int, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """graded: (doc_id, grade 0..n_grades-1). At most max_train of its rows, chosen by a hash of the id, are used.
    Of an id's clashing grades the smallest counts, of its texts the smallest."""
    known = graded.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = (
        texts.join(F.broadcast(sample), "doc_id")  # max_train rows at most
        .groupBy("doc_id", "grade")
        .agg(F.min("text").alias("text"))
        .mapInArrow(_features_task, "doc_id long, grade int, cols array<int>, vals array<float>, extra array<double>")
        .toArrow()
        .sort_by("doc_id")
    )
    grades = rows["grade"].to_numpy()
    if len(set(grades.tolist())) < 2:
        return None
    lengths = np.array([len(x) for x in rows["cols"]])
    join = lambda c, kind: np.concatenate([np.asarray(x.values.to_numpy(zero_copy_only=False), kind) for x in rows[c] if len(x)] or [np.zeros(0, kind)])
    return fit(grades, np.repeat(np.arange(len(grades)), lengths), join("cols", np.int64), join("vals", np.float64), np.array(rows["extra"].to_pylist()), n_grades)


class _Weights(dict):
    """Word -> its weight; bounded, so that a worker's memory doesn't grow with the input."""

    def __init__(self, model: OrdinalModel):
        super().__init__()
        self.w = model.weights

    def __missing__(self, word: bytes) -> float:
        a, b = slots(word)
        x = float(self.w[a] + self.w[b])
        if len(self) < CACHE and len(word) < 64:
            self[word] = x
        return x


def _grades(model: OrdinalModel | None, weight: _Weights | None, texts, n_grades: int, keep_from: int) -> tuple:
    """(expected grade, tail probability, likeliest grade) of each text."""
    n = len(texts)
    if model is None:
        return np.full(n, n_grades - 1.0), np.ones(n), np.full(n, n_grades - 1)
    score, extra = np.zeros(n), np.zeros((n, N_DENSE))
    for i, text in enumerate(texts):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        words = data.split()
        score[i] = sum(map(weight.__getitem__, words)) / max(1, len(words))
        extra[i] = dense(data, words)
    score += np.clip((extra - model.centre) / model.scale, -5, 5) @ model.dense_weights
    below = model.below(score)
    each = np.diff(np.column_stack([np.zeros(n), below, np.ones(n)]), axis=1)
    return (1 - below).sum(1), 1 - below[:, keep_from - 1], each.argmax(1)


def _score_task(model: OrdinalModel | None, n_grades: int, keep_from: int, least: float):
    out = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_prob", pa.float64()), ("predicted_grade", pa.int32()), ("kept", pa.bool_())])

    def task(batches):
        weight = _Weights(model) if model else None
        for batch in batches:
            expected, tail, best = _grades(model, weight, batch.column(1), n_grades, keep_from)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((batch.column(0), expected, tail, best, tail >= least), out, strict=True)], schema=out)

    return task


def _filter_task(model: OrdinalModel | None, text_at: int, n_grades: int, keep_from: int, least: float):
    def task(batches):
        weight = _Weights(model) if model else None
        for batch in batches:
            yield batch.filter(pa.array(_grades(model, weight, batch.column(text_at), n_grades, keep_from)[1] >= least, pa.bool_()))

    return task


def grade_documents(docs: DataFrame, graded: DataFrame, n_grades: int = 3, keep_from: int = 1, least: float = 0.5, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_prob = P(grade >= keep_from), predicted_grade and kept (tail_prob >= least) of every row."""
    model = train(docs, graded, n_grades, max_train, id_col, text_col)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(_score_task(model, n_grades, keep_from, least), "doc_id long, expected_grade double, tail_prob double, predicted_grade int, kept boolean")


def grades_from_labels(labels: DataFrame) -> DataFrame:
    """Ratings of the labels table: 0 low quality, 1 good but toxic, 2 good and not toxic. Learns from ids whose crc32 mod 5 isn't 0."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def keep_good(docs: DataFrame, graded: DataFrame, n_grades: int = 3, keep_from: int = 1, least: float = 0.5, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose tail probability is `least` or more, with all their columns."""
    model = train(docs, graded, n_grades, max_train, id_col, text_col)
    return docs.mapInArrow(_filter_task(model, docs.columns.index(text_col), n_grades, keep_from, least), docs.schema)
