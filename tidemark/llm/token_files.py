"""Token ids in files of independent zstandard frames with a trailing seek table.

Layout of a file: frames of documents' ids (uint16, or uint32 where the vocabulary needs it; little-endian), each frame
a zstandard frame of its own, then one frame with the index (an array of four int64 for each document: doc_id,
frame number, first byte in the frame's content, bytes), then the seek table of the zstandard seekable format: a
skippable frame with compressed size, decompressed size and checksum (low 32 bits of XXH64) of each frame, and a footer.
A reader seeks to the footer, then to the index, and decompresses only frames of requested documents, checking each.

Files hold consecutive ranges of doc_id in ascending order; a task begins a new one when FILE_BYTES of content are in it,
so that a file's index is bounded. A task writes to a name of its own and then renames, so that a repeated task leaves
good files alone; the manifest names the files that count, and what unfinished tasks left is deleted. A null text is empty (its ids are
the end id alone); null ids sort first and are stored as the smallest 64-bit integer. Rows that share an id are stored
each, in the order of a hash of their texts. One document is held in memory whole. An empty table gives no documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import file_system, new_folder, tasks_for
from tidemark.llm.tokens import encoder, tokenizer_path, vocabulary_size

FRAME_BYTES = 256 * 1024
FILE_BYTES = 256 << 20
ROWS_AT_ONCE = 8192
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(1 << 63)


class Writer:
    """Collects documents into frames; finish() adds index and seek table."""

    def __init__(self, sink, dtype: str = "<u2", frame_bytes: int = FRAME_BYTES):
        self.sink, self.dtype, self.frame_bytes = sink, dtype, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.parts: list[bytes] = []
        self.size = self.total = 0
        self.most = np.iinfo(dtype).max

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if len(ids) and ids.max() > self.most:
            raise ValueError(f"id {ids.max()} does not fit {self.dtype}")
        data = ids.astype(self.dtype).tobytes()
        self.index.append((doc_id, len(self.frames), self.size, len(data)))
        self.parts.append(data)
        self.size, self.total = self.size + len(data), self.total + len(data)
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        self._write(b"".join(self.parts))
        self.parts, self.size = [], 0

    def _write(self, content: bytes) -> None:
        data = self.zstd.compress(content)
        self.sink.write(data)
        self.frames.append((len(data), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def finish(self) -> None:
        if self.parts:
            self._frame()
        self._write(np.array(self.index, "<i8").reshape(-1, 4).tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Random access: seek table and index first, then only frames that are asked for."""

    def __init__(self, source, size: int, dtype: str = "<u2"):
        self.source, self.dtype = source, dtype
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.contents, self.checks = table.T
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.zstd = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.frame(n - 1), "<i8").reshape(-1, 4)
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        content = self.zstd.decompress(self._at(int(self.starts[k]), int(self.sizes[k])), max_output_size=int(self.contents[k]))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"checksum of frame {k}")
        return content

    def ids(self, row: int) -> np.ndarray:
        """Ids of the document in this row of the index."""
        _, k, first, size = self.index[row].tolist()
        if self.last[0] != k:
            self.last = (k, self.frame(k))
        return np.frombuffer(self.last[1][first : first + size], self.dtype)

    def find(self, doc_id: int) -> list[int]:
        """Rows of the index with this id (ascending ids: by bisection)."""
        a, b = np.searchsorted(self.index[:, 0], (doc_id, doc_id + 1))
        return list(range(a, b))


def dtype_for(path: str, end: int) -> str:
    """uint16 where the vocabulary and the end id allow it."""
    return "<u2" if max(vocabulary_size(path), end + 1) <= 1 << 16 else "<u4"


def _write_task(folder: str, path: str, end: int, dtype: str, file_bytes: int):
    out = pa.schema([("file", pa.string()), ("size", pa.int64()), ("first_id", pa.int64()), ("tokens", pa.int64()), ("docs", pa.int64())])

    def task(batches):
        store, at = file_system(folder)
        encode, writer, sink, mine, first, tokens = None, None, None, None, None, 0

        def closed():
            writer.finish()
            sink.close()
            name = f"{at}/tokens-{uuid.uuid4().hex}.zst"
            store.move(mine, name)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, store.get_file_info(name).size, first, tokens, len(writer.index)), out, strict=True)], schema=out)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc = NULL_ID if doc is None else doc
                if writer is None:
                    encode, first, tokens, mine = encoder(path), doc, 0, f"{at}/.{uuid.uuid4().hex}.part"
                    store.create_dir(at, recursive=True)
                    sink = store.open_output_stream(mine)
                    writer = Writer(sink, dtype)
                ids = np.append(np.frombuffer(encode.ids(text.as_py()), "<u4"), np.uint32(end))
                writer.add(doc, ids)
                tokens += len(ids)
                if writer.total >= file_bytes:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    return task


def write_tokens(docs: DataFrame, folder: str, end: int = 2, path: str | None = None, dtype: str | None = None, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Writes whole texts' ids in ascending doc_id order; the manifest, one entry per file and in order, with the ids before each."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]  # range bounds are sampled to the driver: they must hold no texts
    ordered = texts.repartitionByRange(tasks_for(docs), *order).sortWithinPartitions(*order, "text")
    path = path or tokenizer_path()
    task = _write_task(folder, path, end, dtype or dtype_for(path, end), file_bytes)
    rows = ordered.mapInArrow(task, "file string, size long, first_id long, tokens long, docs long").collect()  # one per file, in order
    store, at = file_system(folder)
    for left in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if left.base_name.endswith(".part"):
            store.delete_file(left.path)
    manifest, before = [], 0
    for r in rows:
        manifest.append((r.file, r.size, before))
        before += r.tokens
    return manifest


def _read_task(folder: str, dtype: str):
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def task(batches):
        store, _ = file_system(folder)
        for batch in batches:
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(name) as source:
                    reader, rows = Reader(source, size, dtype), []
                    for row in range(len(reader.index)):
                        doc, ids = int(reader.index[row, 0]), reader.ids(row)
                        rows.append((None if doc == NULL_ID else doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == ROWS_AT_ONCE or row == len(reader.index) - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                            rows = []

    return task


def read_tokens(spark, folder: str, manifest: list, dtype: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, from the files."""
    files = spark.createDataFrame(manifest, "file string, size long, start long")
    if manifest:
        files = files.repartition(min(len(manifest), tasks_for(files, 32)))
    return files.mapInArrow(_read_task(folder, dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, end: int = 2, path: str | None = None) -> DataFrame:
    path = path or tokenizer_path()
    folder, dtype = new_folder(docs.sparkSession, "token-files"), dtype_for(path, end)
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, end, path, dtype), dtype)
