"""Token-id files with shuffled planes.

A file holds fixed-size blocks of ids. Each block is turned on its side into byte planes (all low bytes,
then all second bytes, ...) or bit planes, each plane is compressed by itself with zstandard, and planes
of zeros take no room. The footer has the index of the blocks and of the documents, so that any document
can be read from the few blocks that hold it.

    magic | block | block | ... | footer (zstandard over arrays) | footer length (u64) | magic

Edge cases: null and empty texts hold the end id alone; repeated rows are written again, in the order of
(doc_id, text); a null doc_id sorts first; an empty table gives no file and no rows; other columns are not read.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
LEVEL = 3


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of little-endian unsigned 32-bit ids; a plane of zeros is empty."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = np.ascontiguousarray(raw.T)
    return [r.tobytes() if r.any() else b"" for r in rows]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    width = (n + 7) // 8 if bits else n
    rows = np.zeros((len(planes), width), np.uint8)
    for row, plane in zip(rows, planes, strict=True):
        if plane:
            row[:] = np.frombuffer(plane, np.uint8)
    if bits:
        raw = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    else:
        raw = np.ascontiguousarray(rows.T)
    return raw.reshape(-1).view("<u4")


class Writer:
    """Writes ids document by document; holds one block at a time."""

    def __init__(self, out, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = LEVEL):
        self.out, self.block_ids, self.bits = out, block_ids, bits
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at = out.write(MAGIC)
        self.held, self.n_held = [], 0
        self.index: list[list[int]] = []  # offset, ids, then the length of each plane
        self.docs: list[int] = []
        self.named: list[bool] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append(doc_id or 0)
        self.named.append(doc_id is not None)
        self.lengths.append(n)
        self.held.append(ids)
        self.n_held += n
        if self.n_held >= self.block_ids:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        held = b"".join(self.held)
        step = 4 * self.block_ids
        end = len(held) if last else len(held) // step * step
        for i in range(0, end, step):
            ids = np.frombuffer(held[i : i + step], "<u4")
            packed = [self.pack(p) if p else b"" for p in to_planes(ids, self.bits)]
            self.index.append([self.at, len(ids), *map(len, packed)])
            for p in packed:
                self.at += self.out.write(p)
        self.held, self.n_held = [held[end:]], (len(held) - end) // 4

    def close(self) -> None:
        self._flush(last=True)
        arrays = [np.array(self.index, "<i8").reshape(-1, 34 if self.bits else 6), np.array(self.docs, "<i8"), np.array(self.lengths, "<i8"), np.array(self.named, "u1")]
        body = struct.pack("<BQQQ", self.bits, self.block_ids, len(self.index), len(self.docs)) + b"".join(a.tobytes() for a in arrays)
        footer = self.pack(body)
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class Reader:
    """Reads the footer first; documents then come in order, or one by one from their blocks."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, io.SEEK_END)
        file.seek(size - 16)
        (n,), magic = struct.unpack("<Q", file.read(8)), file.read(8)
        file.seek(0)
        if magic != MAGIC or file.read(8) != MAGIC:
            raise ValueError("not a token-plane file")
        file.seek(size - 16 - n)
        self.unpack = zstandard.ZstdDecompressor().decompress
        body = self.unpack(file.read(n))
        bits, self.block_ids, n_blocks, n_docs = struct.unpack_from("<BQQQ", body)
        self.bits, width, at = bool(bits), (34 if bits else 6), struct.calcsize("<BQQQ")
        self.index = np.frombuffer(body, "<i8", n_blocks * width, at).reshape(-1, width)
        at += self.index.nbytes
        self.doc_ids = np.frombuffer(body, "<i8", n_docs, at)
        self.lengths = np.frombuffer(body, "<i8", n_docs, at + 8 * n_docs)
        self.named = np.frombuffer(body, "u1", n_docs, at + 16 * n_docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def block(self, k: int) -> np.ndarray:
        offset, n, *lengths = self.index[k].tolist()
        self.file.seek(offset)
        return from_planes([self.unpack(self.file.read(x)) if x else b"" for x in lengths], n, self.bits)

    def ids(self, doc: int) -> np.ndarray:
        """The ids of one document, from the blocks that hold it."""
        a, b = int(self.starts[doc]), int(self.starts[doc + 1])
        if a == b:
            return np.empty(0, "<u4")
        first, last = a // self.block_ids, (b - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[a - first * self.block_ids : b - first * self.block_ids]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids), block by block."""
        held, at, k = np.empty(0, "<u4"), 0, 0  # held begins at id number `at`
        for doc, (a, n) in enumerate(zip(self.starts[:-1].tolist(), self.lengths.tolist(), strict=True)):
            got = [held]
            have = at + len(held)
            while have < a + n:
                got.append(self.block(k))
                have += len(got[-1])
                k += 1
            held = np.concatenate(got) if len(got) > 1 else held
            held, at = held[a - at :], a
            yield (int(self.doc_ids[doc]) if self.named[doc] else None), a, held[:n]


MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file_no", pa.int32())])


def write_tokens(docs: DataFrame, folder: str, path: str, bits: bool = False, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode `docs` (doc_id, text) and write one file for each range of doc_id; the manifest comes back.

    A task writes under a name of its own try, and only names in the manifest count, so a task
    that is run again after a lost executor leaves no half-written file in the result.
    """
    spark = docs.sparkSession
    n = shared.partitions(spark)
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode = TaskContext.get(), tokens.encoder(path).encode_batch
        store, root = shared.filesystem(folder)
        name = f"ids-{context.partitionId():06d}-{context.taskAttemptId()}.idp"
        writer = out = None
        for part in parts:
            if writer is None and part.num_rows:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
                writer = Writer(out, block_ids, bits)
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids + tokens.END)
        if writer is not None:
            writer.close()
            out.close()
            yield shared._batch([(context.partitionId(), name, len(writer.docs), sum(writer.lengths))], MANIFEST)

    return shared.written(dealt.mapInArrow(write, "part int, path string, n_docs long, n_ids long"), folder, "manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, from the files. The manifest has a row for each file."""
    files = sorted((r.part, r.path, r.n_ids) for r in manifest.collect())
    base, before = [], 0
    for _, name, n_ids in files:
        base.append((name, before))
        before += n_ids

    def read(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = shared.filesystem(folder)

        def rows() -> Iterator[tuple]:
            for part in parts:
                for k in part.column(0).to_pylist():
                    name, first = base[k]
                    with store.open_input_file(f"{root}/{name}") as file:
                        for doc_id, start, ids in Reader(file):
                            yield doc_id, first + start, len(ids), zlib.crc32(ids.tobytes()), k

        yield from shared.batches(rows(), RESULT)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file_no int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.session_setup(spark)
    folder = shared.work_dir(spark, "token-planes")
    docs = shared.documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    manifest = write_tokens(docs, folder, tokens.default_path())
    return read_tokens(spark, folder, manifest)
