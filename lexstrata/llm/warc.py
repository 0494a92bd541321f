"""Content-addressed WARC archive.

Payload bytes are stored once per strong digest (SHA-256), as one deflated block;
record headers are stored exactly and apart. The original records come back by a join.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import keys_for_join
from .storage import shared_dir

#: Payloads below this many bytes are never revisited.
REVISIT_BYTES = 1000
#: Records of one payload beyond which they are dealt over parts in joins.
BUSY = 1_000_000
EPOCH = "2024-01-01T00:00:00Z"
_ENTRY = pa.schema([("page_id", pa.int64()), ("sha256", pa.string()), ("sha1", pa.string()), ("n_bytes", pa.int64()), ("block", pa.binary())])
ENTRY_DDL = "page_id long, sha256 string, sha1 string, n_bytes long, block binary"
STORED_DDL = "sha256 string, sha1 string, n_bytes long, response_id long, copies long, block binary"


class BadRecord(ValueError):
    """An archive record or payload that doesn't agree with its own header or digest."""


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and the deflated payload of each page: what is shuffled to find equal payloads is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for page_id, html in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                payload = (html or "").encode("utf-8")
                rows.append((page_id, hashlib.sha256(payload).hexdigest(), hashlib.sha1(payload).hexdigest(), len(payload), zlib.compress(payload, 1)))
            yield _batch(rows, _ENTRY)


def header(record_type: str, page_id: int | None, url: str | None, sha1: str, n_bytes: int, refers_to: int | None) -> bytes:
    """The header block of a record, up to and with the empty line.

    A revisit has no payload of its own: its Content-Length is 0.
    """
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    uri = "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) for b in (url or "urn:unknown").encode("utf-8")) if url is None or not url.isascii() or any(c <= " " for c in url) else url
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {EPOCH}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if record_type == 'revisit' else n_bytes}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("latin-1")


_HEADERS = pa.schema([("page_id", pa.int64()), ("sha256", pa.string()), ("whole", pa.bool_()), ("header", pa.binary())])


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, url, sha256, sha1, n_bytes, response in zip(*(c.to_pylist() for c in batch.columns)):
            revisit = n_bytes >= REVISIT_BYTES and response is not None and page_id != response
            rows.append((page_id, sha256, not revisit, header("revisit" if revisit else "response", page_id, url, sha1, n_bytes, response)))
        yield _batch(rows, _HEADERS)


def _met(rows: DataFrame, stored: DataFrame, columns: DataFrame) -> DataFrame:
    """``rows`` with the columns of their payload by sha256; rows of a payload that is busy in ``stored`` are dealt over parts, each with the payload's columns."""
    busy = BUSY
    hot = keys_for_join(stored.where(F.col("copies") > busy).select("sha256", F.ceil(F.col("copies") / busy).cast("int").alias("_fan")))
    fan = F.coalesce("_fan", F.lit(1))
    dealt = rows.join(hot, "sha256", "left").withColumn("_part", F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), fan).cast("int")).drop("_fan")
    each = columns.join(hot, "sha256", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), fan - 1))).drop("_fan")
    return dealt.join(each, ["sha256", "_part"]).drop("_part")


def write_archive(pages: DataFrame, path: str) -> None:
    """Write ``path``/payloads (sha256, sha1, n_bytes, response_id, copies, block) and ``path``/headers (page_id, sha256, whole, header).

    Null html is the empty payload; a null url is urn:unknown; of equal payloads the
    greatest page_id is the response (null ids never are, unless alone); repeated rows
    of one page_id are each a record (all of them the response, where theirs is the greatest id); an empty
    table gives two empty tables; other columns aren't read.
    """
    entries = pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_digest, ENTRY_DDL)
    distinct = entries.groupBy("sha256").agg(
        F.first("sha1").alias("sha1"), F.first("n_bytes").alias("n_bytes"), F.max("page_id").alias("response_id"), F.count("*").alias("copies"), F.first("block").alias("block")
    )
    distinct.write.mode("overwrite").option("compression", "none").parquet(f"{path}/payloads")
    html = F.coalesce("html", F.lit("")).cast("binary")
    light = pages.select(F.col("page_id").cast("long"), "url", F.sha2(html, 256).alias("sha256"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("n_bytes"))
    stored = pages.sparkSession.read.parquet(f"{path}/payloads")
    records = _met(light, stored, stored.select("sha256", "response_id"))
    records.select("page_id", "url", "sha256", "sha1", "n_bytes", "response_id").mapInArrow(_headers, "page_id long, sha256 string, whole boolean, header binary").write.mode(
        "overwrite"
    ).option("compression", "zstd").parquet(f"{path}/headers")


def parse_header(block: bytes) -> dict[str, str]:
    if not block.startswith(b"WARC/1.1\r\n") or not block.endswith(b"\r\n\r\n"):
        raise BadRecord("not a WARC header")
    pairs = (line.partition(": ") for line in block.decode("latin-1").split("\r\n")[1:-2])
    return {k.lower(): v for k, _, v in pairs}


_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORD_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PROVED = pa.schema([("sha256", pa.string()), ("real_sha1", pa.string()), ("real_bytes", pa.int64())])


def _id(name: str | None) -> int | None:
    inner = (name or "<urn:page:none>")[10:-1]
    return None if inner == "none" else int(inner)


def payload_of(sha256: str, block: bytes) -> bytes:
    """Inflate a stored payload and verify its digest."""
    payload = zlib.decompress(block)
    if hashlib.sha256(payload).hexdigest() != sha256:
        raise BadRecord(f"payload {sha256} doesn't have its digest")
    return payload


def agreed(fields: dict[str, str], sha1: str, n_bytes: int) -> dict[str, str]:
    """The header's fields, if its digest and length are those of the payload."""
    if "sha1:" + sha1 != fields["warc-payload-digest"]:
        raise BadRecord(f"payload of {fields.get('warc-record-id')} doesn't have its digest")
    if fields["warc-type"] == "response" and n_bytes != int(fields["content-length"]):
        raise BadRecord(f"payload of {fields.get('warc-record-id')} doesn't have its length")
    return fields


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for sha256, block in zip(*(c.to_pylist() for c in batch.columns)):
            payload = payload_of(sha256, block)
            rows.append((sha256, hashlib.sha1(payload).hexdigest(), len(payload)))
        yield _batch(rows, _PROVED)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for head, sha1, n_bytes in zip(*(batch.column(c).to_pylist() for c in ("header", "real_sha1", "real_bytes"))):
            fields = agreed(parse_header(head), sha1, n_bytes)
            revisit = fields["warc-type"] == "revisit"
            rows.append((_id(fields["warc-record-id"]), n_bytes, fields["warc-payload-digest"][5:], fields["warc-type"], _id(fields["warc-refers-to"]) if revisit else None))
        yield _batch(rows, _RECORD)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for head, sha256, block in zip(*(batch.column(c).to_pylist() for c in ("header", "sha256", "block"))):
            payload = b"" if block is None else payload_of(sha256, block)
            if block is not None:
                agreed(parse_header(head), hashlib.sha1(payload).hexdigest(), len(payload))
            out.append(head + payload + b"\r\n\r\n")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary())], names=["page_id", "record"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, each from the stored record, verified.

    Every payload is inflated and digested once; what that gives meets the headers, payload bytes don't.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    proved = payloads.select("sha256", "block").mapInArrow(_prove, "sha256 string, real_sha1 string, real_bytes long")
    heads = spark.read.parquet(f"{path}/headers").select("page_id", "sha256", "header")
    return _met(heads, payloads, proved).select("header", "real_sha1", "real_bytes").mapInArrow(_parse, RECORD_DDL)


def rebuild_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the exact bytes of its WARC record; payload bytes meet only the records that hold them."""
    heads, payloads = (spark.read.parquet(f"{path}/{t}") for t in ("headers", "payloads"))
    columns = ("page_id", "header", "sha256", "block")
    full = _met(heads.where("whole"), payloads, payloads.select("sha256", "block")).select(*columns)
    bare = heads.where("NOT whole").withColumn("block", F.lit(None).cast("binary")).select(*columns)
    return full.unionByName(bare).mapInArrow(_rebuild, "page_id long, record binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archive"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path)


ORACLE_SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""
