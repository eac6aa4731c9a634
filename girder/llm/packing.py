"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows. A document's last short piece goes to the window where
it leaves the least room; when none has room and no window may be opened, the fullest takes as much of the
piece as fits and is emitted. At the end of a partition the open windows are merged; what is left is emitted as
sequences whose length is a power of two, and the last few ids of each partition are merged across partitions.

Edge cases: null and empty texts hold the end id alone; repeated rows are packed again; a null doc_id stays null;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

WINDOW = 4096
OPEN_WINDOWS = 32
#: A partition's last ids below this many go on to the merge across partitions.
TAIL = 256
#: So many partitions are merged in one task: their tails are TAIL ids each at most.
MERGED = 1024

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tail_of", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tail_of long, ids binary"

Piece = tuple[int | None, int, bytes, int]  # doc_id, ids before it in its document, its ids, ids of the document


class Packer:
    """State of one partition: at most `n_open` windows, each below `window` ids."""

    def __init__(self, window: int = WINDOW, n_open: int = OPEN_WINDOWS, tail: int = TAIL):
        self.window, self.n_open, self.tail = window, n_open, tail
        self.open: list[tuple[int, int, list[Piece]]] = []  # room left, serial, pieces; sorted by room
        self.serial = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        """Sequences that are full now that this document has come."""
        n, at = len(ids) // 4, 0
        while n - at >= self.window:
            yield [(doc_id, at, ids[4 * at : 4 * (at + self.window)], n)]
            at += self.window
        if at < n:
            yield from self._place((doc_id, at, ids[4 * at :], n))

    def _place(self, piece: Piece) -> Iterator[list[Piece]]:
        size = len(piece[2]) // 4
        k = bisect.bisect_left(self.open, (size,))
        if k < len(self.open):
            room, _, pieces = self.open.pop(k)
            pieces.append(piece)
            if room == size:
                yield pieces
            else:
                self._keep(room - size, pieces)
        elif len(self.open) < self.n_open:
            self._keep(self.window - size, [piece])
        else:
            room, _, pieces = self.open.pop(0)
            head, rest = cut(piece, room)
            yield [*pieces, head]
            yield from self._place(rest)

    def _keep(self, room: int, pieces: list[Piece]) -> None:
        self.serial += 1
        bisect.insort(self.open, (room, self.serial, pieces))

    def finish(self) -> tuple[list[list[Piece]], list[Piece]]:
        """Sequences made by merging the open windows, and the pieces of the tail."""
        pieces = [p for _, _, ps in self.open for p in ps]
        self.open = []
        return powers(pieces, self.window, self.tail)


def cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc_id, start, ids, total = piece
    return (doc_id, start, ids[: 4 * n], total), (doc_id, start + n, ids[4 * n :], total)


def powers(pieces: list[Piece], window: int, least: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, then windows of ever smaller powers of two down to `least`; what is left comes second."""
    left, out, size = sum(len(p[2]) // 4 for p in pieces), [], window
    todo = pieces[::-1]
    while todo:
        while size > left:
            size = 1 << (size - 1).bit_length() - 1
        if size < least:
            break
        room, got = size, []
        while room:
            piece = todo.pop()
            n = len(piece[2]) // 4
            if n > room:
                piece, rest = cut(piece, room)
                todo.append(rest)
            got.append(piece)
            room -= len(piece[2]) // 4
        left -= size
        out.append(got)
    return out, todo[::-1]


def _rows(sequence_id: int, pieces: list[Piece]) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, total in pieces:
        yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence_id, offset, None, None
        offset += len(ids) // 4


def pack(docs: DataFrame, path: str, folder: str, window: int = WINDOW, n_open: int = OPEN_WINDOWS, forget: bool = False) -> DataFrame:
    """One row for each piece. Partitions are packed as they are scanned: texts are not shuffled.

    With `forget` a worker gives its memory of words back after each task, for sessions that go on to other work.
    """

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        encode, part_no, packer = encoder.encode_batch, TaskContext.get().partitionId(), Packer(window, n_open)

        def rows() -> Iterator[tuple]:
            n = 0
            for part in parts:
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    for sequence in packer.add(doc_id, ids + tokens.END):
                        yield from _rows((part_no << 32) + n, sequence)
                        n += 1
            sequences, tail = packer.finish()
            for k, sequence in enumerate(sequences, n):
                yield from _rows((part_no << 32) + k, sequence)
            for doc_id, start, ids, total in tail:
                yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, None, None, part_no, ids

        yield from shared.batches(rows(), PIECES)
        if forget:
            encoder.forget()

    def merge(table: pa.Table) -> pa.Table:
        got = sorted(table.to_pylist(), key=lambda r: (r["tail_of"], r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["ids"]))
        sequences, _ = powers([(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in got], window, 1)
        first = (1 << 62) + ((got[0]["tail_of"] // MERGED) << 32)
        rows = [r for k, s in enumerate(sequences) for r in _rows(first + k, s)]
        return pa.Table.from_batches([shared._batch(rows, PIECES)])

    pieces = shared.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES_DDL), folder, "pieces")
    tails = pieces.where(F.col("tail_of").isNotNull()).groupBy(F.floor(F.col("tail_of") / MERGED)).applyInArrow(merge, PIECES_DDL)
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pieces.where(F.col("tail_of").isNull()).select(out).unionAll(tails.select(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.session_setup(spark)
    return pack(shared.documents(spark, sf_dir), tokens.default_path(), shared.work_dir(spark, "packing"))
