"""Long repeats with a run-length index.

A byte goes if a string of `match` bytes that covers it also starts earlier in the corpus. Strings of that length
never cross documents and are judged on the input.

1. Texts are sorted by doc_id into shards, which are written once to the shared folder.
2. Every string of `match` bytes holds an anchor: the place with the smallest hash of `gram` bytes among those in the
   string. Equal strings hold equal anchors at equal places, so a string has an earlier copy only if one of its
   anchor's equals has it. Around an anchor lies its context: all bytes of strings that hold it.
3. A shard sends each distinct (anchor, context) once, as hashes of 64 bits each, to a bucket by the anchor's hash. The
   bucket answers for each in which shard and portion of it the context comes first, and whether an anchor has more
   contexts than one. Hashes only say where to look; nothing is removed by them.
4. Contexts that come again, joined where they overlap, go to the portion that has the first of them (each distinct
   stretch once a shard, with all its places). The portion's first contexts are built into a run-length index: a
   run-compressed Burrows-Wheeler transform with suffix-array samples at the ends of its runs, and for each
   stretch of rows that agree in `match` bytes its earliest place. The stretches are streamed through it from their
   ends: matching statistics, up to `match`. A place whose match is that long and whose row has an earlier place
   marks its string.
5. Anchors with several contexts may share strings though the contexts differ. Their first contexts are cut into bands of
   `band` starts (`hot_band`, if an anchor has more than `hot` contexts). What all strings of a band share, some 85
   bytes (97), is the key by which bands go to buckets. There distinct bands are indexed, some keys at a time, and all
   are streamed through the index as above.
6. Each shard takes away what was marked.

A passage that a third of all documents have costs one entry and one stretch a shard. A line that very many documents
have amid different words has as many contexts; its bands of few starts are equal within the line, which leaves one a
shard, and have different keys beyond it. Rows sent are as many as there is something to send. Every piece of a shard's
work is a function of its file and of rows that were written.

Edge cases: null and empty texts have no bytes and keep the digest of nothing; rows of one doc_id are ordered by text, and
the later ones of equal rows lose all if they have `match` bytes; a null doc_id comes first; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .minhash import _blocks, _mix

@dataclasses.dataclass(frozen=True)
class Sizes:
    """All lengths; tasks get them by value."""

    #: Bytes of a string that must come again, and of the anchor in it.
    match: int = 100
    gram: int = 36
    #: Strings that start in one piece of a text; longer texts are hashed piece by piece.
    piece: int = 1 << 17
    #: Starts of strings in a band of a context, and in one of an anchor that has more than `hot` contexts.
    band: int = 16
    hot_band: int = 4
    hot: int = 4096
    #: Bytes of bands in one index, but for a key that has more.
    index_bytes: int = 1 << 20
    #: Bytes of a shard whose first contexts are in one index.
    portion: int = 1 << 21
    #: Starts in a stretch that is streamed, and bytes that are streamed at a time.
    stretch: int = 1 << 9
    stream_bytes: int = 1 << 22


SIZES = Sizes()
BASE = np.uint64(0x9E3779B97F4A7C15)


# ---- the index
class RunIndex:
    """Run-length index over some strings, in their order.

    Symbols are bytes; each string ends with an end mark of its own, smaller than bytes and ordered by string.
    `begin` says where each string begins in the corpus, as an integer that grows with the corpus; strings may
    overlap there. Without it they lie one after another.
    """

    def __init__(self, strings: list[bytes], depth: int, begin: np.ndarray | None = None):
        self.depth, n = depth, len(strings)
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(self.lengths + 1) - 1  # places of the end marks
        self.begin = self.ends - self.lengths if begin is None else begin
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int32) + np.int32(n)
        text[self.ends] = np.arange(n)
        self.text = text
        rows, self.same = _sorted_suffixes(text, int(self.lengths.max(initial=0)) + 1, depth)
        before = text[rows - 1]  # of the first suffix, the last mark
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.run_start, self.run_head = heads, before[heads]
        self.run_end = np.concatenate([heads[1:], [len(text)]]) - 1
        self.sample_start, self.sample_end = rows[self.run_start], rows[self.run_end]
        # where the row before the first row of a run is: runs in the order of their symbols, stably
        order = np.argsort(self.run_head, kind="stable")
        sizes = self.run_end - self.run_start + 1
        self.run_to = np.empty(len(heads), np.int64)
        self.run_to[order] = np.cumsum(sizes[order]) - sizes[order]
        # rows that agree in `depth` symbols, and the earliest place among them
        self.class_start = np.flatnonzero(~self.same)
        of = np.searchsorted(self.ends, rows)
        places = self.begin[of] + rows - (self.ends - self.lengths)[of]
        self.earliest = np.minimum.reduceat(places, self.class_start) if len(rows) else rows

    def _prepare(self) -> None:
        """Runs by head, and of each run's samples how far the string goes on."""
        if hasattr(self, "by_head"):
            return
        self.by_head = np.argsort(self.run_head, kind="stable")
        self.head_keys = self.run_head[self.by_head].astype(np.int64) * len(self.run_head) + self.by_head
        # directories from rows to runs and classes, in place of searches
        self.run_of = np.repeat(np.arange(len(self.run_head), dtype=np.int32), self.run_end - self.run_start + 1)
        self.class_of = np.cumsum(~self.same, dtype=np.int32) - np.int32(1)
        self.left_end, self.left_start = (self.ends[np.searchsorted(self.ends, x)] - x for x in (self.sample_end, self.sample_start))
        self.words = _words(np.maximum(self.text - np.int32(len(self.lengths)), 0).astype(np.uint8))

    def statistics(self, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of patterns (`sizes` bytes of `body` from `starts`), all at once from their ends.

        For each step the patterns' numbers, the place in them, the length of the longest match there, `depth` at most, and
        a row that has such a match. A row whose run does not go on with the pattern's symbol gives way to the
        nearest one above or below that does, by the samples at its run's end: whichever has more in common. `begin`
        has for each pattern the string whose end it is compared with first; it says where to look, no more.
        """
        self._prepare()
        n, runs, depth, words = len(self.lengths), len(self.run_head), self.depth, _words(body)
        order = np.argsort(-sizes, kind="stable")
        ends, left = (starts + sizes)[order], sizes[order]
        row, length = np.zeros(len(order), np.int64) if begin is None else begin[order], np.zeros(len(order), np.int64)
        active = len(order)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            while active and left[active - 1] < step:
                active -= 1
            row, length = row[:active], length[:active]
            at = ends[:active] - step
            c = body[at].astype(np.int64) + n
            run = self.run_of[row]
            off = np.flatnonzero(self.run_head[run] != c)
            if len(off):
                asked, known, mine, after = c[off], length[off], self.class_of[row[off]], at[off] + 1
                q = np.searchsorted(self.head_keys, asked * runs + run[off])
                up, down = np.maximum(q - 1, 0), np.minimum(q, runs - 1)
                has_up, has_down = (q > 0) & (self.head_keys[up] // runs == asked), (q < runs) & (self.head_keys[down] // runs == asked)
                up, down = self.by_head[up], self.by_head[down]
                # a row of the same class has as much in common as counts
                above = np.where(has_up, np.where((known >= depth) & (self.class_of[self.run_end[up]] == mine), depth, -2), -1)
                below = np.where(has_down & (above < depth), np.where((known >= depth) & (self.class_of[self.run_start[down]] == mine), depth, -2), -1)
                look = np.flatnonzero((above == -2) & (below < depth))
                above[look] = self._common(self.sample_end[up[look]], np.minimum(known, self.left_end[up])[look], words, after[look])
                look = np.flatnonzero((below == -2) & (above < depth))
                below[look] = self._common(self.sample_start[down[look]], np.minimum(known, self.left_start[down])[look], words, after[look])
                run[off] = np.where(above >= below, up, down)
                row[off] = np.where(above >= below, self.run_end[up], self.run_start[down])
                length[off] = np.maximum(above, below)  # -1: no run has the symbol, and any row will do
            row = self.run_to[run] + row - self.run_start[run]
            length = np.minimum(length + 1, depth)
            yield order[:active], left[:active] - step, length, row

    def earlier(self, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(patterns, places in them, earliest place in the corpus) of all matches of `depth` symbols."""
        out = []
        for which, at, length, row in self.statistics(body, starts, sizes, begin):
            hit = np.flatnonzero(length >= self.depth)
            if len(hit):
                out.append((which[hit], at[hit], self.earliest[self.class_of[row[hit]]]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _common(self, place: np.ndarray, most: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at `place` share with the patterns from `at` on, `most` at most. Eight at a time."""
        out, going = most.copy(), np.flatnonzero(most > 0)
        for k in range(0, int(most.max(initial=0)), 8):
            x = self.words[place[going] + k] ^ words[at[going] + k]
            differ = x != 0
            low = x[differ]
            some = going[differ]
            out[some] = np.minimum(most[some], k + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // 8)
            going = going[~differ]
            going = going[most[going] > k + 8]
            if not len(going):
                break
        return out


def _words(body: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer, the first lowest."""
    padded = np.concatenate([body, np.zeros(16, np.uint8)])
    return np.ndarray((len(body) + 9,), "<u8", padded, 0, (1,))


def _sorted_suffixes(text: np.ndarray, longest: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and whether each agrees with the one before it in `depth` symbols. Prefixes double."""
    n = len(text)
    bits = max(1, int(text.max(initial=0)).bit_length() + 1)
    have = 1
    while 2 * have * bits <= 62:
        have *= 2
    key = np.zeros(n, np.int64)
    for k in range(have):
        key <<= bits
        key[: max(0, n - k)] += text[k:] + 1
    steps = _steps(depth, have)
    agreed = {1: text} if 1 in steps else {}
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        del ranked
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
        if have in steps:
            agreed[have] = rank
        if have >= longest or new.all():
            break
        np.multiply(rank, n + 1, out=key, dtype=np.int64)
        key[: max(0, n - have)] += rank[have:]
        have *= 2
    same, at = np.ones(max(0, n - 1), bool), 0
    if max(steps, default=0) > have:  # no two suffixes agree that far
        same[:] = False
        steps = []
    for size in steps:
        a, b = order[1:] + at, order[:-1] + at
        inside = (a < n) & (b < n)
        same &= inside
        same[inside] &= agreed[size][a[inside]] == agreed[size][b[inside]]
        at += size
    return order, np.concatenate([np.zeros(min(1, n), bool), same])


def _steps(depth: int, have: int) -> list[int]:
    """Sizes that add up to `depth`, of 1, `have` and its doubles: only their ranks are kept."""
    out, size = [], have
    while 2 * size <= depth:
        size *= 2
    while depth:
        while size > depth:
            size = size // 2 if size > have else 1
        out.append(size)
        depth -= size
    return out


# ---- anchors
def _powers(n: int, known: dict = {"n": 0}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if known["n"] < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            known["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
            known["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
        known["n"] = n
    return known["up"], known["down"]


def _slide(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """least over each `width` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Anchors:
    """Of a shard: text number, place, hash of the anchor, hash of its context, and the bytes to its left and right."""

    def __init__(self, texts: list[bytes], sizes: Sizes = SIZES):
        self.sizes, self.match, self.gram = sizes, sizes.match, sizes.gram
        self.reach, match, piece = self.match - self.gram, self.match, sizes.piece  # a context has `reach` bytes to the left, `match` to the right
        parts, block, size, twice = [], [], 0, False
        for k, raw in enumerate(texts):
            starts = len(raw) - match + 1
            for a in range(0, max(0, starts), piece):
                b = min(starts, a + piece)
                lo, hi = max(0, a - self.reach), min(len(raw), b + match + self.reach)
                block.append((k, lo, raw[lo:hi], a - lo, b - lo, len(raw)))
                size += hi - lo
                twice |= b < starts
                if size >= piece:
                    parts.append(self._block(block))
                    block, size = [], 0
        if block:
            parts.append(self._block(block))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64)]
        if twice:  # an anchor at the border of two pieces may be found from both
            keep = np.unique(np.stack(columns[:2]), axis=1, return_index=True)[1]
            columns = [c[keep] for c in columns]
        self.text, self.place, self.hash, self.context, self.left, self.right = columns
        before = np.cumsum([0, *map(len, texts)])
        self.portion = (before[self.text] + self.place) // sizes.portion
        self.order = np.lexsort((self.place, self.text, self.context, self.hash))
        h, c = self.hash[self.order], self.context[self.order]
        self.new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.empty(0, bool)
        self.first = self.order[self.new]  # of each distinct (anchor, context) its first place, sorted by hash
        self.entry = np.cumsum(self.new) - 1  # of each place in `order`
        self.several = np.bincount(self.entry, minlength=len(self.first)) > 1

    def _block(self, block: list[tuple]) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(x[2] for x in block), np.uint8)
        n, k, w = len(raw), self.gram, self.reach + 1
        up, down = _powers(n + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n])])
        hashed = _mix((total[k:] - total[:-k]) * down[: n - k + 1])
        sizes = np.array([len(x[2]) for x in block])
        begin = np.cumsum(sizes) - sizes
        marks = np.zeros(n + 1, np.int8)  # 1 where a string of `match` bytes may start
        np.add.at(marks, begin + [x[3] for x in block], 1)
        np.add.at(marks, begin + [x[4] for x in block], -1)
        starts = np.cumsum(marks[: n - self.match + 1]).astype(bool)
        lowest = np.where(starts, _slide(hashed, w, np.minimum), np.uint64(0))
        border = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero((_slide(np.concatenate([border, lowest, border]), w, np.maximum) == hashed) & (hashed > 0))
        which = np.searchsorted(begin, at, "right") - 1
        place = at - begin[which] + np.array([x[1] for x in block])[which]
        left = np.minimum(self.reach, place)
        right = np.minimum(self.match, np.array([x[5] for x in block])[which] - place)
        context = _mix((total[at + right] - total[at - left]) * down[at - left] + (left * 1024 + right).astype(np.uint64) * BASE)
        return [np.array([x[0] for x in block])[which], place, _mix(hashed[at] + BASE), context, left, right]  # mixed again, as lowest hashes are all low

    def buckets(self, n: int) -> np.ndarray:
        """Borders of the buckets in `first`: bucket b has first[borders[b]:borders[b + 1]]."""
        return np.searchsorted(self.hash[self.first] >> np.uint64(32), (np.arange(n + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(n))


# ---- shards
def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """One file of texts for each range of doc_id; the manifest comes back. Only files that it names count."""
    n = shared.partitions(docs.sparkSession)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "raw")
    schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.binary())])

    def write(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = shared.filesystem(folder)
        name, out, n_docs = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.arrows", None, 0
        for part in parts:
            if out is None and part.num_rows:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
                writer = pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            if part.num_rows:
                writer.write_batch(pa.RecordBatch.from_arrays(part.columns, schema=schema))
                n_docs += part.num_rows
        if out is not None:
            writer.close()
            out.close()
            yield shared._batch([(context.partitionId(), name, n_docs)], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64())]))

    return shared.written(dealt.mapInArrow(write, "part int, path string, n_docs long"), folder, "manifest")


def read_shard(folder: str, name: str) -> tuple[list, list[bytes]]:
    store, root = shared.filesystem(folder)
    with store.open_input_stream(f"{root}/{name}") as file:
        table = pa.ipc.open_stream(file).read_all()
    return table.column(0).to_pylist(), table.column(1).to_pylist()


#: What a shard is told of a context that it has first: it comes again; its anchor has others; its anchor has very many.
AGAIN, ASKED, MANY = 1, 2, 4


def answers(spark: SparkSession, folder: str, names: list[str], sizes: Sizes) -> DataFrame:
    """(shard, bucket, codes, targets): for each distinct (anchor, context) that the shard sent to the bucket.

    The target is the shard and portion that has the context first, -1 if it is this shard, which gets a code then.
    """
    n = len(names)
    sent = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("entries", pa.binary()), ("portions", pa.binary())])
    told = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("codes", pa.binary()), ("targets", pa.binary())])

    def send(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for shard in part.column(0).to_pylist():
                found = Anchors(read_shard(folder, names[shard])[1], sizes)
                borders = found.buckets(n)
                pairs = np.stack([found.hash[found.first], found.context[found.first]])
                portions = found.portion[found.first].astype("<i4")
                spans = [(b, borders[b], borders[b + 1]) for b in range(n) if borders[b] < borders[b + 1]]
                yield from shared.batches(((b, shard, pairs[:, x:y].tobytes(), portions[x:y].tobytes()) for b, x, y in spans), sent, 64)

    def answer(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(parts, 1):
            block = block.sort_by("shard")
            shards, bucket = block.column("shard").to_numpy(), block.column("bucket")[0].as_py()
            each = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in block.column("entries").to_pylist()]
            portion = np.frombuffer(b"".join(block.column("portions").to_pylist()), "<i4")
            counts = [x.shape[1] for x in each]
            (hashed, context), shard = np.concatenate(each, axis=1), np.repeat(shards, counts)
            order = np.lexsort((np.arange(len(hashed)), context, hashed))  # places follow the shards' order
            h, c = hashed[order], context[order]
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            contexts = np.bincount(np.cumsum(new_h) - 1, weights=new)[np.cumsum(new_h) - 1]
            entry = np.cumsum(new) - 1
            again = np.bincount(entry)[entry] > 1
            codes, targets = np.empty(len(h), np.uint8), np.empty((len(h), 2), "<i4")
            codes[order] = np.where(new, AGAIN * again + ASKED * (contexts > 1) + MANY * (contexts > sizes.hot), 0)
            first = order[new][entry]
            targets[order] = np.where(new[:, None], -1, np.stack([shard[first], portion[first]], axis=1))
            ends = np.cumsum(counts)[:-1]
            yield shared._batch([(s, bucket, x.tobytes(), y.tobytes()) for s, x, y in zip(shards.tolist(), np.split(codes, ends), np.split(targets, ends), strict=True)], told)

    rows = spark.range(0, n, 1, max(1, n)).mapInArrow(send, "bucket int, shard int, entries binary, portions binary")
    dealt = rows.repartition(shared.partitions(spark), "bucket").sortWithinPartitions("bucket")
    return shared.written(dealt.mapInArrow(answer, "shard int, bucket int, codes binary, targets binary"), folder, "answers", compression="zstd")


def _by_shard(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartitionByRange(shared.partitions(rows.sparkSession), "shard").sortWithinPartitions("shard", *order)


def bands(left: int, right: int, match: int, reach: int, width: int) -> list[tuple[int, int, int]]:
    """(bytes before the anchor: of the key, at least, at most) of the strings of each band."""
    out = []
    for first in range(0, reach + 1, width):
        low, high = max(first, match - right), min(first + width - 1, left)
        if low <= high:
            out.append((first, low, high))
    return out


def joined(text: np.ndarray, a: np.ndarray, b: np.ndarray, target: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, a, b, target) of spans joined where they overlap and have one target."""
    order = np.lexsort((a, text, target))
    text, a, b, target = text[order], a[order], b[order], target[order]
    if not len(text):
        return
    far = np.concatenate([[0], b[:-1]])
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (target[1:] != target[:-1]) | (a[1:] > far[1:])])
    heads = np.flatnonzero(new)
    yield from zip(text[heads].tolist(), a[heads].tolist(), np.maximum.reduceat(b, heads).tolist(), target[heads].tolist(), strict=True)


COPIES, BANDS = 0, 1
FIRST, LATER = 0, 1
SENT = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("role", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("head", pa.binary()), ("places", pa.binary()), ("body", pa.binary())])
SENT_DDL = "kind int, key long, role int, shard int, keys binary, head binary, places binary, body binary"


class Parcel:
    """Distinct strings for one key, each with its places (text, start) in the shard, the first one first."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.places: list[list[tuple[int, int]]] = []
        self.keys: list[tuple[int, int]] = []
        self.size = 0

    def add(self, string: bytes, text: int, start: int, key: int | None = None) -> None:
        k = self.known.setdefault(string if key is None else (key, string), len(self.known))
        if k == len(self.places):
            self.places.append([])
            self.size += len(string)
            if key is not None:
                self.keys.append((key, xxhash.xxh3_64_intdigest(string)))
        self.places[k].append((text, start))

    def row(self, kind: int, key: int, role: int, shard: int) -> tuple:
        strings = [x if isinstance(x, bytes) else x[1] for x in self.known]
        head = np.array([(len(s), len(p)) for s, p in zip(strings, self.places, strict=True)], "<i4")
        places = np.array([x for p in self.places for x in sorted(p)], "<i4")
        return kind, key, role, shard, np.array(self.keys, np.uint64).tobytes(), head.tobytes(), places.tobytes(), b"".join(strings)


def parcels(found: Anchors, texts: list[bytes], codes: np.ndarray, targets: np.ndarray, shard: int, n: int) -> Iterator[tuple]:
    """What a shard sends: first contexts that come again, stretches that come later, bands of anchors with several contexts."""
    sizes, mine = found.sizes, targets[found.entry, 0] < 0
    portion = found.portion[found.first]
    span = lambda at: (found.text[at], found.place[at] - found.left[at], found.place[at] + found.right[at])

    first = found.first[(targets[:, 0] < 0) & ((codes & AGAIN > 0) | found.several)]
    held, now = Parcel(), -1
    for t, a, b, target in joined(*span(first), found.portion[first]):
        if target != now and held.size:
            yield held.row(COPIES, (shard << 32) + now, FIRST, shard)
            held = Parcel()
        now = target
        held.add(texts[t][a:b], t, a)
    if held.size:
        yield held.row(COPIES, (shard << 32) + now, FIRST, shard)

    # places of a context that another shard has first, and all but the first of one that this shard has first
    own = (np.int64(shard) << 32) + portion
    to = np.where(mine, own[found.entry], (targets[found.entry, 0].astype(np.int64) << 32) + targets[found.entry, 1])
    later = ~mine | ~found.new
    at = found.order[later]
    held, now = Parcel(), -1
    for t, a, b, target in joined(*span(at), to[later]):
        raw = texts[t]
        for x in range(a, max(a + 1, b - found.match + 1), sizes.stretch):
            if held.size and (target != now or held.size > sizes.stream_bytes // 16):
                yield held.row(COPIES, now, LATER, shard)
                held = Parcel()
            now = target
            held.add(raw[x : min(b, x + sizes.stretch + found.match - 1)], t, x)
    if held.size:
        yield held.row(COPIES, now, LATER, shard)

    held_by: dict[int, Parcel] = {}
    asked = (codes & ASKED > 0) & (targets[:, 0] < 0)
    at, many = found.first[asked], (codes[asked] & MANY > 0).tolist()
    for t, p, a, b, hot in zip(found.text[at].tolist(), found.place[at].tolist(), found.left[at].tolist(), found.right[at].tolist(), many, strict=True):
        raw, width = texts[t], sizes.hot_band if hot else sizes.band
        for start, low, high in bands(a, b, found.match, found.reach, width):
            key = xxhash.xxh3_64_intdigest(raw[p - start : p - start + found.match - width + 1], start)
            bucket = (key >> 32) * n >> 32
            held_by.setdefault(bucket, Parcel()).add(raw[p - high : p - low + found.match], t, p - high, key)
    for bucket in sorted(held_by):
        yield held_by.pop(bucket).row(BANDS, bucket, FIRST, shard)


class Strings:
    """Strings of parcels, one after another, with their shards and places."""

    def __init__(self, table: pa.Table):
        self.body = np.frombuffer(_joint(table.column("body")), np.uint8)
        head = [np.frombuffer(x, "<i4").reshape(-1, 2) for x in table.column("head").to_pylist()]
        self.shard = np.repeat(table.column("shard").to_numpy().astype(np.int64), [len(x) for x in head])
        self.size, self.n_places = np.concatenate(head).T.astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.text, self.at = np.frombuffer(b"".join(table.column("places").to_pylist()), "<i4").reshape(-1, 2).T.astype(np.int64)
        self.first = np.cumsum(self.n_places) - self.n_places  # of each string its first place

    def of(self, k: int) -> bytes:
        return self.body[self.start[k] : self.start[k] + self.size[k]].tobytes()

    def marked(self, index: RunIndex, some: np.ndarray, places: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(shard, text, first byte, end) of what the index has earlier; `places` are those of the corpus.

        Matches of neighbouring places that come from neighbouring places are one run, and a run goes at each place of its
        string that lies behind its source.
        """
        which, off, early = index.earlier(self.body, self.start[some], self.size[some], begin)
        if not len(which):
            return tuple(np.empty(0, np.int64) for _ in range(4))
        order = np.lexsort((off, which))
        which, off, shift = which[order], off[order], (early - off)[order]
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (off[1:] != off[:-1] + 1) | (shift[1:] != shift[:-1])])
        heads = np.flatnonzero(new)
        last = off[np.concatenate([heads[1:], [len(off)]]) - 1]
        string, off, shift = some[which[heads]], off[heads], shift[heads]
        times = self.n_places[string]
        run = np.repeat(np.arange(len(string)), times)
        place = np.repeat(self.first[string], times) + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
        good = shift[run] < places[place]
        run, place = run[good], place[good]
        return self.shard[string[run]], self.text[place], self.at[place] + off[run], self.at[place] + last[run] + index.depth


def marks(answered: DataFrame, folder: str, names: list[str], sizes: Sizes) -> DataFrame:
    """(shard, spans): text number, first byte and end of what goes, as 32-bit integers."""
    told = pa.schema([("shard", pa.int32()), ("spans", pa.binary())])
    n = len(names)

    def send(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(parts, 1):
            shard = block.column("shard")[0].as_py()
            texts = read_shard(folder, names[shard])[1]
            found = Anchors(texts, sizes)
            codes, targets, borders = np.zeros(len(found.first), np.uint8), np.empty((len(found.first), 2), "<i4"), found.buckets(n)
            for bucket, blob, to in zip(*(block.column(c).to_pylist() for c in ("bucket", "codes", "targets")), strict=True):
                codes[borders[bucket] : borders[bucket + 1]] = np.frombuffer(blob, np.uint8)
                targets[borders[bucket] : borders[bucket + 1]] = np.frombuffer(to, "<i4").reshape(-1, 2)
            yield from shared.batches(parcels(found, texts, codes, targets, shard, n), SENT, 16)

    def mark(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, group in _runs(parts):
            for spans in marked_copies(group, sizes) if kind == COPIES else marked_bands(group, sizes):
                yield from shared.batches(_by_shards(*spans), told, 64)

    parts = shared.partitions(answered.sparkSession)
    rows = _by_shard(answered, "bucket").mapInArrow(send, SENT_DDL)
    dealt = rows.repartition(parts, "kind", "key").sortWithinPartitions("kind", "key", "role", "shard")
    return shared.written(dealt.mapInArrow(mark, "shard int, spans binary"), folder, "marks", compression="zstd")


def _runs(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.Table]]]:
    """Rows one by one, grouped by kind and key."""
    rows = ((t["kind"][0].as_py(), t["key"][0].as_py(), t) for part in parts for k in range(part.num_rows) if (t := pa.Table.from_batches([part.slice(k, 1)])))
    for (kind, _), group in itertools.groupby(rows, lambda r: r[:2]):
        yield kind, (t for _, _, t in group)


def _by_shards(shard: np.ndarray, *span: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(shard, kind="stable")
    shard, spans = shard[order], np.stack(span)[:, order]
    for part, s in zip(np.split(spans, np.flatnonzero(shard[1:] != shard[:-1]) + 1, axis=1), np.unique(shard).tolist(), strict=True):
        yield s, np.stack(_joined(part)).astype("<i4").tobytes()


def marked_copies(group: Iterable[pa.Table], sizes: Sizes) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of all shards against the first contexts of one portion, which come before them in `group`."""
    first, later, size, index = [], [], 0, None

    def streamed() -> Iterator[tuple[np.ndarray, ...]]:
        strings = Strings(pa.concat_tables(later))
        # stretches of later shards lie behind all of the portion
        place = np.where(np.repeat(strings.shard, strings.n_places) > shard, np.int64(1) << 62, (strings.text << 40) + strings.at)
        got = strings.marked(index, np.arange(len(strings.size)), place)
        if len(got[0]):
            yield got

    for row in group:
        if row["role"][0].as_py() == FIRST:
            first.append(row)
            continue
        if index is None:
            strings = Strings(pa.concat_tables(first))
            shard = int(strings.shard[0])
            index = RunIndex([strings.of(k) for k in range(len(strings.size))], sizes.match, (strings.text[strings.first] << 40) + strings.at[strings.first])
        later.append(row)
        size += len(row["body"][0].as_py())
        if size >= sizes.stream_bytes:
            yield from streamed()
            later, size = [], 0
    if later:
        yield from streamed()


def marked_bands(group: Iterable[pa.Table], sizes: Sizes) -> Iterator[tuple[np.ndarray, ...]]:
    """Bands of one bucket against those of their key."""
    table = pa.concat_tables(group)
    strings = Strings(table)
    key, whole = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table.column("keys").to_pylist()]).T
    shard = np.repeat(strings.shard, strings.n_places)
    text = np.unique(np.stack([shard, strings.text]), axis=1, return_inverse=True)[1].ravel()  # texts in the order of the corpus
    place = (text.astype(np.int64) << 40) + strings.at
    order = np.lexsort((place[strings.first], whole, key))
    k = key[order]
    of = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]])) - 1
    order = order[np.bincount(of, weights=strings.n_places[order])[of] > 1]  # a key with one place has nothing to match
    for some in _portions(order, key, strings.size, sizes.index_bytes):
        distinct = np.concatenate([[True], (key[some][1:] != key[some][:-1]) | (whole[some][1:] != whole[some][:-1])])
        indexed = some[distinct]
        index = RunIndex([strings.of(k) for k in indexed], sizes.match, place[strings.first[indexed]])
        got = strings.marked(index, some, place, np.cumsum(distinct) - 1)
        if len(got[0]):
            yield got


def _joint(column: pa.ChunkedArray) -> memoryview:
    """The bytes of all values, one after another, without a copy where they lie in one chunk."""
    pieces = []
    for c in column.chunks:
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        pieces.append(memoryview(c.buffers()[2])[int(ends[0]) : int(ends[-1])])
    return pieces[0] if len(pieces) == 1 else memoryview(b"".join(pieces))


def _portions(order: np.ndarray, key: np.ndarray, size: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Parts of `order`, which is sorted by key: whole keys, with `least` bytes but for the last."""
    if not len(order):
        return
    total = np.cumsum(size[order])
    ends = np.concatenate([np.flatnonzero(key[order][1:] != key[order][:-1]) + 1, [len(order)]])
    a = 0
    while a < len(order):
        want = (total[a - 1] if a else 0) + least
        b = int(ends[min(len(ends) - 1, np.searchsorted(total[ends - 1], want))])
        yield order[a:b]
        a = b


def _joined(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (text, first, end) with those that overlap or touch joined."""
    order = np.lexsort((spans[1], spans[0]))
    t, a, b = spans[:, order]
    far = np.maximum.accumulate((t << 40) + b)  # ends so far; those of earlier texts are smaller
    new = np.concatenate([[True], (t << 40)[1:] + a[1:] > far[:-1]])
    last = np.concatenate([new[1:], [True]])
    return t[new], a[new], far[last] - (t[last] << 40)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def without_repeats(docs: DataFrame, folder: str, sizes: Sizes = SIZES) -> DataFrame:
    """For each document its bytes, those that go, the stretches they form and the digest of the rest."""
    spark = docs.sparkSession
    names = [r.path for r in sorted(write_shards(docs, folder).collect(), key=lambda r: r.part)]  # a row for each shard
    answered = answers(spark, folder, names, sizes)
    marked = marks(answered, folder, names, sizes)

    def take(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(parts, 1):
            shard = block.column("shard")[0].as_py()
            doc_ids, texts = read_shard(folder, names[shard])
            text, a, b = np.concatenate([np.frombuffer(x, "<i4").reshape(3, -1).astype(np.int64) for x in block.column("spans").to_pylist()], axis=1)
            order = np.argsort(text, kind="stable")
            text, a, b = text[order], a[order], b[order]
            border = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()

            def rows() -> Iterator[tuple]:
                for k, raw in enumerate(texts):
                    i, j = border[k], border[k + 1]
                    if i == j:
                        yield doc_ids[k], len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
                        continue
                    depth = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(depth, a[i:j], 1)
                    np.add.at(depth, b[i:j], -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    yield doc_ids[k], len(raw), int(gone.sum()), n_spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()

            yield from shared.batches(rows(), RESULT)

    every = marked.unionAll(spark.range(0, len(names), 1, max(1, len(names))).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("spans")))
    return _by_shard(every).mapInArrow(take, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.session_setup(spark)
    return without_repeats(shared.documents(spark, sf_dir), shared.work_dir(spark, "run-index"))


#: A string of 100 bytes is named by its MD5; texts are cut into pieces that overlap by 99 bytes, so that no string is missed.
ORACLE = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (SELECT doc_id, k, substring(h, k * 4000 + 1, 4198) AS p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 4000 + 1)) AS k FROM t)),
place AS (SELECT doc_id, k * 2000 + j AS pos, p, j FROM (SELECT doc_id, k, p, unnest(range(0, least(2000, length(p) // 2 - 99))) AS j FROM piece WHERE length(p) >= 200)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, md5_number(substring(p, 2 * j + 1, 200)) AS key FROM place) QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1),
step AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100, TRUE)::INT AS new FROM later),
run AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM step),
span AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM run GROUP BY doc_id, run),
edge AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM span),
left_over AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substring(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head FROM edge JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN left_over USING (doc_id)
"""
