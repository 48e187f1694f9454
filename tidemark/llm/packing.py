"""Packing token sequences: bounded-space online best fit, per partition, then a merge of what is left open.

A task reads its documents once and holds `windows` open windows of `length` tokens. Whole windows are cut off a
document first; its rest goes where it fits best. When it fits nowhere and no further window may be opened, the fullest
is filled up with a cut of it (if the gap is worth a cut) and emitted. Windows still open at the end of a task carry
their ids along and are merged across tasks: whole groups of them are laid end to end and cut every `length` tokens, so
that a group leaves one short window at most.

Memory of a task: its open windows and one document. A null or empty text is one token, the end id. Repeated rows are
packed each. Null ids are passed on. Sequence ids are unique over the whole result; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.tokens import encoder, tokenizer_path

LENGTH, WINDOWS, LEAST_CUT = 1024, 64, 32
MERGE_WINDOWS = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


class Packer:
    """Open windows of one task. emit(window) is called with each window as it is closed."""

    def __init__(self, length: int, windows: int, least_cut: int, emit):
        self.length, self.windows, self.least_cut, self.emit = length, windows, least_cut, emit
        self.gaps: list[tuple[int, int]] = []  # (gap, number) of open windows, ascending
        self.held: dict[int, list[tuple]] = {}
        self.count = 0

    def _put(self, gap: int, number: int, doc, start: int, ids: bytes, doc_tokens: int) -> None:
        self.held[number].append((doc, start, self.length - gap, ids, doc_tokens))
        if left := gap - len(ids) // 4:
            bisect.insort(self.gaps, (left, number))
        else:
            self.emit(number, self.held.pop(number))

    def _open(self, doc, start: int, ids: bytes, doc_tokens: int) -> None:
        self.count += 1
        self.held[self.count] = []
        self._put(self.length, self.count, doc, start, ids, doc_tokens)

    def add(self, doc, ids: bytes) -> None:
        n, start, size = len(ids) // 4, 0, self.length
        while n - start >= size:
            self._open(doc, start, ids[4 * start : 4 * (start + size)], n)
            start += size
        while start < n:
            need = n - start
            at = bisect.bisect_left(self.gaps, (need, 0))
            if at < len(self.gaps):
                self._put(*self.gaps.pop(at), doc, start, ids[4 * start :], n)
                return
            if len(self.gaps) < self.windows:
                self._open(doc, start, ids[4 * start :], n)
                return
            gap, number = self.gaps.pop(0)  # the fullest
            if gap >= self.least_cut:
                self._put(gap, number, doc, start, ids[4 * start : 4 * (start + gap)], n)
                start += gap
            else:
                self.emit(number, self.held.pop(number))


def _pack_task(path: str, end: int, length: int, windows: int, least_cut: int):
    schema = pa.schema([*_FIELDS, ("open_ids", pa.binary())])
    last = np.array([end], "<u4").tobytes()

    def task(batches):
        encode, base, rows = encoder(path), TaskContext.get().partitionId() << 33, []

        def emit(number, pieces, is_open=False):
            for doc, start, offset, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, base + number, offset, ids if is_open else None))

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        packer = Packer(length, windows, least_cut, emit)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, encode.ids(text.as_py()) + last)
                if len(rows) > 8192:
                    yield flushed()
        for number, pieces in packer.held.items():
            emit(number, pieces, True)
        if rows:
            yield flushed()

    return task


def _merge_task(length: int):
    """Windows of a task laid end to end and cut every `length` tokens. Rows come sorted by (sequence_id, offset)."""
    schema = pa.schema(_FIELDS)

    def task(batches):
        base, number, offset = (1 << 62) + (TaskContext.get().partitionId() << 33), 0, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids, start = r["open_ids"], r["start"]
                while ids:
                    part = ids[: 4 * (length - offset)]
                    rows.append((r["doc_id"], start, len(part) // 4, zlib.crc32(part), r["doc_tokens"], base + number, offset))
                    start, offset, ids = start + len(part) // 4, offset + len(part) // 4, ids[len(part) :]
                    if offset == length:
                        number, offset = number + 1, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return task


def pack(docs: DataFrame, end: int = 0, length: int = LENGTH, windows: int = WINDOWS, least_cut: int = LEAST_CUT, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    pieces = written(texts.mapInArrow(_pack_task(path or tokenizer_path(), end, length, windows, least_cut), SCHEMA + ", open_ids binary"), "pieces")
    left = pieces.where(F.col("open_ids").isNotNull())
    groups = max(1, -(-left.where("offset = 0").count() // MERGE_WINDOWS))
    merged = left.repartition(groups, F.xxhash64("sequence_id")).sortWithinPartitions("sequence_id", "offset").mapInArrow(_merge_task(length), SCHEMA)
    names = [n for n, _ in _FIELDS]
    return pieces.where(F.col("open_ids").isNull()).select(names).union(merged.select(names))
