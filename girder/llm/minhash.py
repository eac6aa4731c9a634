"""Near duplicates by MinHash: shingle sets with a Jaccard similarity of at least `NEAR` (exact, on full sets).

1. Each document's set of word shingles gives `HASHES` minima of universal hash functions. Documents with equal
   sets form one class at once, so a group of copies, however large, goes on as one node.
2. Minima are banded. A class is in one bucket for each band; buckets of one class are dropped. Large buckets are
   split by salt into blocks.
3. In each block, signatures are compared, and of all pairs that look near a spanning forest of the most alike is
   proposed: at most one pair fewer than the block has members.
4. Proposed pairs are confirmed on their full sets, and large-star and small-star give components.
5. Only buckets that hold more than one component are looked at again. In one of `BLOCK` members at most, all that is not
   of its largest component is compared with all of the bucket on full sets. A pair within one component needs no
   test, as it can change nothing.
6. Larger ones, such as those of a passage that very many texts have, are not compared so, as that would grow with the
   square of their size. Their members' shingles are ranked by the number of sets that have them. A pair that shares a
   shingle of at most `RARE` sets shares one among the first fifth of both sets (prefix filter); such shingles have
   few sets, and what they propose is confirmed on full sets. A pair without such a shingle has only common ones in
   common, so what it shares is told by the sets' common shingles and their sizes alone: members equal in both are one
   class, and one for each class is compared. Only texts that are four-fifths common shingles come this far.

A pair of similarity 0.8 shares no band with a probability of (1 - 0.8^4)^28, below 10^-6; its signatures look
further apart than `LOOKS_NEAR` with one below 10^-5.

Edge cases: without words (null and empty texts too) a set is empty and linked with nothing; with fewer words than a
shingle has, the words are one shingle; repeated rows are equal sets; a null doc_id is its own component unless a
linked document has a doc_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components

NEAR = 80  # in hundredths
BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
#: Of the 8-bit minima so many must agree before sets are compared: five standard deviations below 0.8.
LOOKS_NEAR = 68
BLOCK = 512
#: A shingle is common if more sets than these have it.
RARE = 64
#: Blocks of full sets have so many shingles at most, but for one more set.
BLOCK_SHINGLES = 1 << 21
SEED = 0x9E3779B97F4A7C15


def _functions(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add hash functions on 64 bits, of which the upper 32 are used."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x94D049BB133111EB)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z alone are lowered, ASCII blanks alone split
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, SEED + width, np.uint64)
    for k in range(width):
        out = _mix(out + hashed[k : k + n])
    return np.unique(out)


def minima(found: np.ndarray, functions: tuple[np.ndarray, np.ndarray], step: int = 1024) -> np.ndarray:
    a, b = functions
    out = np.full(len(a), ~np.uint64(0), np.uint64)
    for k in range(0, len(found), step):
        out = np.minimum(out, (a[:, None] * found[None, k : k + step] + b[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def _keys(minima: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = minima.reshape(bands, -1).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(SEED)
    for column in rows.T:
        out = _mix(out ^ column)
    return out.view(np.int64)


SIGNED = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
SIGNED_DDL = "_row long, doc_id long, n_shingles long, key binary, signature binary, bands array<long>"


def signed(rows: DataFrame, width: int) -> DataFrame:
    """For each of `rows` (_row, doc_id, text) its set's size and identity, 8-bit minima and band keys."""
    functions = _functions(HASHES)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, keys, signatures, bands = [], [], [], []
            for text in part.column(2):
                found = shingles(text.as_py(), width)
                sizes.append(len(found))
                if not len(found):
                    keys.append(None), signatures.append(None), bands.append(None)
                    continue
                least = minima(found, functions)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                signatures.append(least.astype(np.uint8).tobytes())
                bands.append(_keys(least, BANDS))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, f.type) for c, f in zip((sizes, keys, signatures, bands), list(SIGNED)[2:], strict=True))], schema=SIGNED)

    return rows.mapInArrow(run, SIGNED_DDL)


def _blocks(parts: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows with equal values in the first columns, from batches sorted by them."""
    held: list[pa.Table] = []
    for part in parts:
        table = pa.Table.from_batches([part])
        if not table.num_rows:
            continue
        keys = np.stack([table.column(k).to_numpy() for k in range(n_keys)])
        ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if held and any(held[-1].column(k)[-1].as_py() != keys[k, 0] for k in range(n_keys)):
            yield pa.concat_tables(held)
            held = []
        a = 0
        for b in ends.tolist():
            yield pa.concat_tables([*held, table.slice(a, b - a)])
            held, a = [], b
        held.append(table.slice(a))
    if held:
        yield pa.concat_tables(held)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _signatures(table: pa.Table, name: str = "signature") -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _forest(nodes: np.ndarray, signs: np.ndarray) -> list[tuple[int, int]]:
    """Prim's algorithm over pairs that look near; more agreement first."""
    n = len(nodes)
    out, best, tie, left = [], np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    now = 0
    left[now] = False
    for _ in range(n - 1):
        agree = (signs == signs[now]).sum(axis=1)
        better = left & (agree > best)
        best[better], tie[better] = agree[better], now
        now = int(np.where(left, best, -2).argmax())
        left[now] = False
        if best[now] >= LOOKS_NEAR:
            out.append((int(nodes[now]), int(nodes[tie[now]])))
    return out


def proposed(members: DataFrame) -> DataFrame:
    """Pairs (a < b) for confirmation, from (bucket, salt, node, signature). Blocks have some BLOCK members at most."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            for block in _blocks(parts, 2):
                if block.num_rows > 1:
                    block = block.sort_by("node")
                    for a, b in _forest(block.column("node").to_numpy(), _signatures(block)):
                        yield min(a, b), max(a, b)

        yield from shared.batches(pairs(), PAIRS)

    n = shared.partitions(members.sparkSession)
    dealt = members.select("bucket", "salt", "node", "signature").repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def packed(found: np.ndarray) -> bytes:
    """The whole hashes: two different shingles of a pair of sets of 20,000 fall together once in 10^10 pairs."""
    return found.astype("<u8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def full_sets(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the rows at these places. Sets are made again from the texts, which are shuffled once.

    The join is a merge at any size: the places grow with the input and are never broadcast.
    """

    def pack(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed(shingles(t.as_py(), width)) for t in part.column(1)], pa.binary())], schema=schema)

    asked = nodes.select(F.col("node").alias("_row")).distinct().hint("merge")
    return rows.select("_row", "text").join(asked, "_row", "left_semi").mapInArrow(pack, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """Those of `pairs` (a, b: nodes) whose full sets are near."""

    def compare(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good, last, known = [], None, None
            for a, x, y in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if a != last:
                    last, known = a, unpacked(x)
                other = unpacked(y)
                both = len(np.intersect1d(known, other, assume_unique=True))
                good.append(100 * both >= near * (len(known) + len(other) - both))
            yield pa.RecordBatch.from_arrays(part.columns[:2], schema=PAIRS).filter(pa.array(good, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def between(members: DataFrame, near: int) -> DataFrame:
    """All near pairs (a < b) of different components, from (bucket, i, j, role, node, root, shingles).

    In each block (bucket, i, j) the full sets of role 0 are compared with those of role 1; only links leave a block.
    """

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            for block in _blocks(parts, 3):
                role = block.column("role").to_numpy()
                asks, gives = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
                if not len(asks) or not len(gives):
                    continue
                nodes, roots = block.column("node").to_numpy(), block.column("root").to_numpy()
                sets = [unpacked(x) for x in block.column("shingles").to_pylist()]
                known, place = np.unique(np.concatenate([sets[k] for k in gives]), return_inverse=True)
                sizes = np.array([len(sets[k]) for k in gives])
                starts = np.cumsum(sizes) - sizes
                for k in asks:
                    mine = sets[k]
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    has = np.zeros(len(known), bool)
                    has[at[known[at] == mine]] = True
                    both = np.add.reduceat(has[place], starts, dtype=np.int64)
                    link = (100 * both >= near * (sizes + len(mine) - both)) & (roots[gives] != roots[k])
                    for node in nodes[gives[link]].tolist():
                        yield min(node, int(nodes[k])), max(node, int(nodes[k]))

        yield from shared.batches(pairs(), PAIRS)

    n = shared.partitions(members.sparkSession)
    dealt = members.select("bucket", "i", "j", "role", "node", "root", "shingles").repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def each_shingle(sets: DataFrame) -> DataFrame:
    """(node, s): a row for each shingle."""
    schema = pa.schema([("node", pa.int64()), ("s", pa.int64())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [unpacked(x).view(np.int64) for x in part.column(1).to_pylist()]
            nodes = np.repeat(part.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], schema=schema)

    return sets.select("node", "shingles").mapInArrow(run, "node long, s long")


def stand_ins(commons: DataFrame) -> DataFrame:
    """(node, shingles): the common shingles of (node, n, common), and others that no set has, up to n."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for node, n, common in zip(*(c.to_pylist() for c in part.columns), strict=True):
                more = _mix(np.arange(n - len(common), dtype=np.uint64) + np.uint64(node) * np.uint64(SEED))
                out.append(packed(np.unique(np.concatenate([np.array(common, np.int64).view(np.uint64), more]))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], schema=schema)

    return commons.select("node", "n", "common").mapInArrow(run, "node long, shingles binary")


def in_large_buckets(large: DataFrame, sets: DataFrame, near: int, folder: str) -> DataFrame:
    """Links (a, b) that join the components of (bucket, node, root, n_shingles), without a comparison of all pairs.

    Rows grow with the shingles of the members. A posting has RARE sets at most. The counts of common shingles are summed
    before they are shuffled; the join by shingle is left to Spark's splitting of skewed joins.
    """
    members = shared.written(large.select("node", "root", F.col("n_shingles").alias("n")).distinct(), folder, "large")
    each = shared.written(each_shingle(sets.join(members.select("node"), "node", "left_semi")), folder, "shingles")
    counts = each.groupBy("s").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    ranked = each.join(counts.hint("merge"), "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sets", "s"))).alias("known"))  # a text's own shingles
    ranked = ranked.join(members, "node")
    prefix = F.col("n") - F.ceil(F.col("n") * near / 100) + 1 - (F.col("n") - F.size("known"))  # those of one set come first
    common = F.transform(F.filter("known", lambda x: x["sets"] > RARE), lambda x: x["s"])
    first = F.filter(F.slice("known", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int")), lambda x: x["sets"] <= RARE)
    ranked = shared.written(ranked.select("node", "root", "n", F.transform(first, lambda x: x["s"]).alias("first"), common.alias("common")), folder, "ranked")

    posting = ranked.select("node", "root", "n", F.explode("first").alias("s"))
    other = posting.select(*(F.col(c).alias(f"{c}_2") for c in ("node", "root", "n")), "s")
    pairs = posting.join(other, "s").where((F.col("node") < F.col("node_2")) & (F.col("root") != F.col("root_2")) & (100 * F.least("n", "n_2") >= near * F.greatest("n", "n_2")))
    pairs = shared.written(pairs.select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct(), folder, "by-rare")
    links = shared.written(confirmed(pairs, sets, near), folder, "by-rare-links")

    full = ranked.where(100 * F.size("common") >= near * F.col("n")).withColumn("key", F.sha2(F.array_join(F.col("common").cast("array<string>"), ","), 256))
    full = full.select("node", "root", "n", "key", "common", (100 * F.size("common") >= near * (2 * F.col("n") - F.size("common"))).alias("tight"))
    full = shared.written(full, folder, "common")
    classes = full.groupBy("key", "n").agg(F.min(F.struct("node", "root")).alias("one"), F.first("common").alias("common"), F.first("tight").alias("tight"))
    classes = shared.written(classes.select("key", "n", F.col("one.node").alias("node"), F.col("one.root").alias("root"), "common", "tight"), folder, "common-classes")
    named = full.select("node", "key", "n").join(classes.select("key", "n", F.col("node").alias("one"), "tight"), ["key", "n"])
    # members of a tight class are near each other; of two near members of different classes the smaller one's is tight
    stars = named.where(F.col("tight") & (F.col("node") != F.col("one"))).select(F.col("one").alias("a"), F.col("node").alias("b"))
    at = large.select("bucket", "node").join(classes, "node").select("bucket", "node", "tight", F.when(F.col("tight"), F.col("root")).otherwise(-1 - F.col("node")).alias("root"))
    sizes = at.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.max("tight").alias("any")).where("any")
    at = at.join(sizes, "bucket")
    part = F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asks = at.withColumn("i", part).withColumn("j", others).withColumn("role", F.lit(0))
    gives = at.where("tight").withColumn("j", part).withColumn("i", others).withColumn("role", F.lit(1))
    columns = ["bucket", "i", "j", "role", "node", "root"]
    found = shared.written(between(asks.select(columns).unionAll(gives.select(columns)).join(stand_ins(classes), "node"), near), folder, "by-common")
    # what holds for one of a class that is not tight holds for each of its members
    loose = named.where("not tight").select("one", "node")
    sides = [found.select(F.col(x).alias("one"), F.col(y).alias("far")) for x, y in (("a", "b"), ("b", "a"))]
    more = sides[0].unionAll(sides[1]).join(loose, "one").select(F.least("node", "far").alias("a"), F.greatest("node", "far").alias("b"))
    return links.unionAll(stars).unionAll(found).unionAll(more)


def near_groups(docs: DataFrame, folder: str, width: int = 5, near: int = NEAR) -> DataFrame:
    """One row for each document: _row, doc_id, n_shingles, component_id, and `kept` for one row of each component."""
    rows, name = shared.addressed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), folder)
    return grouped(rows.select(name, "doc_id", "text"), folder, width, near)


def grouped(rows: DataFrame, folder: str, width: int = 5, near: int = NEAR) -> DataFrame:
    """`near_groups` of written rows (_row, doc_id, text): they are read twice, and must have the same addresses then."""
    own = shared.written(signed(rows, width), folder, "signed")
    first = F.min(F.struct("_row", "n_shingles", "signature", "bands")).alias("first")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row"))
    classes = own.where("key is not null").groupBy("key").agg(first, F.min(order).alias("best"))
    classes = shared.written(classes.select("key", F.col("first._row").alias("node"), "first.n_shingles", "best", "first.signature", "first.bands"), folder, "classes")

    each = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = each.join(sizes, "bucket").join(classes.select("node", "n_shingles", "signature"), "node")
    parts = F.ceil(F.col("n") / BLOCK)
    members = shared.written(members.select("bucket", "n", F.pmod(F.xxhash64("node", "bucket"), parts).alias("salt"), "node", "n_shingles", "signature"), folder, "members")

    tried = shared.written(proposed(members), folder, "proposed")
    sets = shared.written(full_sets(rows, members, width), folder, "sets")
    links = shared.written(confirmed(tried, sets, near), folder, "confirmed")
    roots = components(links.select(F.col("b").alias("u"), F.col("a").alias("v")), f"{folder}/stars-1")

    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n_root"), F.sum("n_shingles").alias("s_root"))
    mixed = by_root.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_roots"), F.max(F.struct("n_root", "root", "s_root")).alias("main"), F.sum("n_root").alias("n"), F.sum("s_root").alias("s")).where("n_roots > 1")
    # the rest of a bucket, in parts i, against all of it, in parts j: no pair within the largest component is made
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.select("bucket", "n", F.col("main.root").alias("main"), blocks(F.col("n"), F.col("s")).alias("j_parts"), blocks(F.col("n") - F.col("main.n_root"), F.col("s") - F.col("main.s_root")).alias("i_parts"))
    open_ = shared.written(placed.select("bucket", "node", "root", "n_shingles").join(mixed, "bucket"), folder, "open")
    part = lambda parts: F.pmod(F.xxhash64("node", "bucket"), parts).cast("int")
    others = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    small, large = open_.where(F.col("n") <= BLOCK), open_.where(F.col("n") > BLOCK)
    asks = small.where("root <> main").withColumn("i", part(F.col("i_parts"))).withColumn("j", others("j_parts")).withColumn("role", F.lit(0))
    gives = small.withColumn("j", part(F.col("j_parts"))).withColumn("i", others("i_parts")).withColumn("role", F.lit(1))
    columns = ["bucket", "i", "j", "role", "node", "root"]
    more = between(asks.select(columns).unionAll(gives.select(columns)).join(sets, "node"), near)
    if not large.isEmpty():
        more = more.unionAll(in_large_buckets(large, sets, near, f"{folder}/large"))
    more = shared.written(more, folder, "between")
    if not more.isEmpty():
        links = links.unionAll(more)
        roots = components(links.select(F.col("b").alias("u"), F.col("a").alias("v")), f"{folder}/stars-2")

    groups = classes.select("key", "node", "best").join(roots, "node", "left").select("key", "best", F.coalesce("root", "node").alias("root"))
    groups = shared.written(groups, folder, "groups")
    best = groups.groupBy("root").agg(F.min("best").alias("top"))
    named = groups.select("key", "root").join(best, "root").select("key", "top")
    got = own.select("_row", "doc_id", "n_shingles", "key").join(named, "key", "left")
    alone = F.col("top").isNull()
    return got.select("_row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"), (alone | (F.col("top._row") == F.col("_row"))).alias("kept"))


def deduplicated(docs: DataFrame, folder: str, width: int = 5) -> DataFrame:
    """The rows of `docs` that stay, one of each component, with all their columns."""
    rows, name = shared.addressed(docs, folder)
    own = rows.select(F.col(name).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return shared.rows_kept(rows, name, grouped(own, folder, width).where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.session_setup(spark)
    return near_groups(shared.documents(spark, sf_dir), shared.work_dir(spark, "minhash"), width=4).drop("_row")


#: All pairs that share a shingle, held against the limit, and what can be reached over them.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
cut AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle FROM cut),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT c.a, c.b FROM common c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
side AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS far FROM documents UNION SELECT reach.doc_id, side.b FROM reach JOIN side ON side.a = reach.far),
c AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
