"""Quality rules by repetition coverage: how much of a text stands inside repeated n-grams and lines.

For each of several n-gram lengths, rolling 64-bit hashes of word n-grams are computed in numpy for a whole batch of
texts at once; n-grams that occur twice or more in the same text mark their words, and the characters (code points) of
the marked words are added up. Repeated lines are measured likewise.

Nulls and texts without words have no words and no coverage and fail the base rule (fewer than 10 words). A text is
held whole; batches are cut by words, so that one long text is a batch of its own. Repeated rows are judged alike, and
each is returned. Columns that the operator doesn't know are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Share of a text's word characters that may stand inside duplicated n-grams, by n-gram length.
COVERAGE = {3: 0.50, 5: 0.30, 7: 0.28, 10: 0.25}
#: Share of a text's word characters that may stand in lines that repeat an earlier line.
LINES = 0.30
#: Share of symbols among the characters of words.
SYMBOL_SHARE = 0.10
BATCH_WORDS = 1_000_000
_C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected boolean, "
    + ", ".join(f"dup_chars_{n} double" for n in COVERAGE)
    + ", dup_line_chars double"
)


def words_of(text: str, data: bytes) -> list:
    """Words as bytes or str: bytes.split() splits at just these six characters; other texts need code points."""
    return data.split() if len(data) == len(text) else WORDS.findall(text)


def repeated(grams: np.ndarray) -> np.ndarray:
    """Which of these hashes occur more than once."""
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(grams), bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.searchsorted(twice, grams)
    at[at == len(twice)] = 0
    return twice[at] == grams


def coverage(hashes: np.ndarray, doc: np.ndarray, lengths) -> dict[int, np.ndarray]:
    """For each n-gram length, which words stand inside an n-gram that its own text has twice or more."""
    out, rolling, total = {}, hashes.copy(), len(hashes)
    salt = (doc.astype(np.uint64) + np.uint64(1)) * _D
    for n in range(1, max(lengths) + 1):
        if n > 1:
            if n > total:
                break
            rolling = rolling[:-1] * _C + hashes[n - 1 :]
        if n not in lengths:
            continue
        starts = np.flatnonzero(doc[: total - n + 1] == doc[n - 1 :])
        mixed = (rolling[starts] ^ (rolling[starts] >> np.uint64(29))) * _C + salt[starts]
        marks = np.zeros(total + 1, np.int32)
        found = starts[repeated(mixed)]
        np.add.at(marks, found, 1)
        np.add.at(marks, found + n, -1)
        out[n] = np.cumsum(marks[:-1]) > 0
    return {n: out.get(n, np.zeros(total, bool)) for n in lengths}


def measure(ids: list, texts: list) -> dict[str, list | np.ndarray]:
    """The columns of SCHEMA for one batch."""
    n = len(texts)
    all_words: list = []
    n_words, chars, symbols, dup_lines, line_chars = (np.zeros(n, np.int64) for _ in range(5))
    for i, text in enumerate(texts):
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        words = words_of(text, data)
        n_words[i] = len(words)
        all_words += words
        chars[i] = len(text) - len(data) + len(data.translate(None, SPACES))
        symbols[i] = len(data) - len(data.translate(None, SYMBOLS))
        lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
        if len(lines) > 1:
            seen: set[bytes] = set()
            for x in lines:
                if x in seen:
                    dup_lines[i] += 1
                    line_chars[i] += sum(len(w.decode("utf-8", "surrogatepass")) for w in x.split())
                else:
                    seen.add(x)
    doc = np.repeat(np.arange(n), n_words)
    hashes = np.fromiter(map(hash, all_words), np.int64, len(all_words)).view(np.uint64)
    sizes = np.fromiter(map(len, all_words), np.int64, len(all_words))
    lengths = sorted({5, *COVERAGE})
    covered = coverage(hashes, doc, lengths) if len(hashes) else {k: np.zeros(0, bool) for k in lengths}
    share = {k: np.bincount(doc, weights=covered[k] * sizes, minlength=n) / np.maximum(chars, 1) for k in COVERAGE}
    repeat_words = np.bincount(doc, weights=covered[5], minlength=n).astype(np.int64)
    base_failed = (n_words < 10) | (100 * repeat_words > 20 * n_words)
    lines_share = line_chars / np.maximum(chars, 1)
    bad = (lines_share > LINES) | (symbols > SYMBOL_SHARE * chars)
    for k, most in COVERAGE.items():
        bad |= share[k] > most
    return {
        "doc_id": ids, "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": base_failed, "kept": ~(base_failed | bad), "rejected": bad,
        **{f"dup_chars_{k}": share[k] for k in COVERAGE}, "dup_line_chars": lines_share,
    }


def _batches(batch: pa.RecordBatch):
    """(ids, texts), cut so that a batch holds a bounded number of characters, or one text."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if ids and size + len(t or "") > 6 * BATCH_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t or "")
    if ids:
        yield ids, texts


def _task(batches):
    kinds = pa.schema([pa.field(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])
    for batch in batches:
        for ids, texts in _batches(batch):
            found = measure(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in kinds], schema=kinds)


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the measures, base_failed, kept and rejected. No shuffle: texts are read where they lie.

    rejected is the method's own verdict (coverage of n-grams and lines, symbols); kept also needs the base rule to hold.
    """
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(_task, SCHEMA)


def _filter_task(text_at: int):
    def task(batches):
        for batch in batches:
            keep: list[bool] = []
            for ids, texts in _batches(pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(text_at)], names=["i", "t"])):
                keep += (~measure(ids, texts)["rejected"]).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return task


def keep_unrepetitive(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the method doesn't reject, with all their columns; nothing is shuffled."""
    return docs.mapInArrow(_filter_task(docs.columns.index(text_col)), docs.schema)
