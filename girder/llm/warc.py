"""WARC archives: one gzip member for each record, written by tasks and read back record by record.

Equal payloads of at least `LEAST_BYTES` bytes are stored once, in the record with the smallest page_id; the
others are `revisit` records that point to it. The reader inflates a member a little at a time, takes each block
by its Content-Length and checks its digest.

Edge cases: a null html is an empty payload, and a null url an empty target; repeated rows of one page_id are each
written (the first is the response, the others revisit the same page_id); a null page_id is written as an empty
field and read back as null, and is chosen last; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST_BYTES = 100
READ_BYTES = 1 << 16
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, level: int = 6) -> bytes:
    """One record as a gzip member. A revisit has the HTTP headers but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"Content-Length: %d\r\n\r\n" % len(block)
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def members(file) -> Iterator[Iterator[bytes]]:
    """For each gzip member the pieces of what it holds, as they are inflated."""
    rest = file.read(READ_BYTES)
    while rest:
        unpack, after = zlib.decompressobj(31), [rest]

        def pieces(unpack=unpack, after=after) -> Iterator[bytes]:
            data = after.pop()
            while not unpack.eof:
                if not data and not (data := file.read(READ_BYTES)):
                    raise ValueError("a gzip member ends early")
                if got := unpack.decompress(data, READ_BYTES):
                    yield got
                data = unpack.unconsumed_tail
            after.append(unpack.unused_data)

        held = pieces()
        yield held
        for _ in held:
            pass
        rest = after.pop() or file.read(READ_BYTES)


class Records:
    """Records of an archive in order: fields, and the digest and length of block and payload.

    With `keep`, the payload itself too. A block that is too short, too long or of another digest raises ValueError.
    """

    def __init__(self, file, keep: bool = False):
        self.file, self.keep = file, keep

    def __iter__(self) -> Iterator[dict]:
        for pieces in members(self.file):
            yield self._record(pieces)

    def _record(self, pieces: Iterator[bytes]) -> dict:
        held = b""
        while b"\r\n\r\n" not in held:
            if not (more := next(pieces, b"")):
                raise ValueError("a header ends early")
            held += more
        head, held = held.split(b"\r\n\r\n", 1)
        first, *lines = head.split(b"\r\n")
        if first != VERSION:
            raise ValueError("not a record")
        fields = {k: v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
        left, block, payload, kept, http = int(fields["Content-Length"]), hashlib.sha256(), hashlib.sha256(), [], b""
        inside, size = False, 0
        while True:
            part, held = held[:left], held[left:]
            left -= len(part)
            block.update(part)
            if not inside:
                http += part
                if b"\r\n\r\n" in http:
                    http, part = http.split(b"\r\n\r\n", 1)
                    inside = True
            if inside:
                payload.update(part)
                size += len(part)
                if self.keep:
                    kept.append(part)
            if not left:
                break
            if not (held := next(pieces, b"")):
                raise ValueError("a block ends early")
        if held + b"".join(pieces) != b"\r\n\r\n":
            raise ValueError("a block goes on after its length")
        http_fields = {k.lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in http.split(b"\r\n")[1:])}
        revisit = fields["WARC-Type"] == "revisit"
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if fields["WARC-Block-Digest"] != f"sha256:{block.hexdigest()}" or not revisit and digest != payload.hexdigest():
            raise ValueError("a digest differs")
        if not revisit and size != int(http_fields["content-length"]):
            raise ValueError("a payload's length differs")
        out = {"fields": fields, "payload_bytes": int(http_fields["content-length"]), "payload_digest": digest}
        return out | ({"payload": b"".join(kept)} if self.keep else {})


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to and whether the record revisits.

    Digests that occur once are not joined at all. Those that repeat are grouped with partial sums first, and the
    join is left to Spark's skew handling, as one payload may be that of a third of all pages. `pages` is a scan of files:
    repeated rows of one page_id are told apart by file and place in it, which no other split of the scan changes.
    """
    place = shared.file_place(pages).alias("_row")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"), place)
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("key", F.when(F.length("payload") >= LEAST_BYTES, F.col("digest")))
    first = rows.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("_row"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    alone = rows.withColumn("key", F.coalesce("key", F.concat(F.lit("-"), F.xxhash64("_row").cast("string"))))
    got = alone.join(first, "key", "left")
    revisit = F.col("first").isNotNull() & (F.col("first._row") != F.col("_row"))
    return got.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """An archive for each task; only archives named in the manifest count."""

    def write(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = shared.filesystem(folder)
        name, out, n = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz", None, 0
        for part in parts:
            if out is None and part.num_rows:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
            for row in part.to_pylist():
                out.write(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"]))
                n += 1
        if out is not None:
            out.close()
            yield shared._batch([(name, n)], MANIFEST)

    return shared.written(rows.mapInArrow(write, "path string, n_records long"), folder, "manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    names = sorted(r.path for r in manifest.collect())  # a row for each archive

    def read(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = shared.filesystem(folder)

        def rows() -> Iterator[tuple]:
            for part in parts:
                for k in part.column(0).to_pylist():
                    with store.open_input_stream(f"{root}/{names[k]}") as file:
                        for r in Records(file):
                            f = r["fields"]
                            yield _page(f["WARC-Record-ID"]), r["payload_bytes"], r["payload_digest"], f["WARC-Type"], _page(f.get("WARC-Refers-To"))

        yield from shared.batches(rows(), RESULT)

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.session_setup(spark)
    folder = shared.work_dir(spark, "warc")
    return read_archives(spark, folder, write_archives(typed(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
