"""Content-addressed WARC archive: payload bytes once by verified digest, exact record headers beside them.

Defined cases: a null html is an empty payload; an empty table gives an empty archive; a null url has no target line, line
breaks in a url are percent-encoded; repeated rows are records of their own; of a group of equal payloads all rows that
carry the smallest page_id are responses, a null page_id counts as largest (if all are null, all are responses). Other
columns of ``pages`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import map_arrow, write_table

#: Payloads of fewer bytes are never revisits.
LEAST_SHARED = 100
#: A payload with more records is given to the reading join this many records at a time.
RECORDS_PER_COPY = 512


@dataclass
class Archive:
    """``headers(header, digest, copies)``: a row per record; ``payloads(digest, payload_bytes, first_page, copies, frame)``: a row per digest."""

    headers: DataFrame
    payloads: DataFrame


def _compressed(batches):
    """The html column as one zstd frame a row: what is shuffled and stored is the compressed payload."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    for batch in batches:
        html = batch.column("html")
        frames = pa.array((pack(x.as_buffer() if x.is_valid else b"") for x in html), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("digest"), batch.column("payload_bytes"), frames], names=["page_id", "digest", "payload_bytes", "frame"])


def _lines(*lines: Column) -> Column:
    return F.encode(F.concat_ws("\r\n", *lines, F.lit(""), F.lit("")), "utf-8")


def _header() -> Column:
    revisit = F.col("record_type") == "revisit"
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first_page")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )


def write_archive(pages: DataFrame, least_shared: int = LEAST_SHARED) -> Archive:
    """Writes both tables of the archive into the scratch folder.

    Payloads are reduced to one row a digest before and after one shuffle by digest, as compressed frames; length and a
    second hash of all copies have to agree. Headers, a few hundred bytes a record, join the digests' first pages.
    """
    digests = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select(
        "page_id", "url", "html", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("payload_bytes")
    )
    frames = digests.select("page_id", "digest", "payload_bytes", "html").transform(map_arrow, _compressed, "page_id long, digest string, payload_bytes long, frame binary")
    check = F.xxhash64("frame")
    payloads = frames.groupBy("digest").agg(
        F.min("payload_bytes").alias("payload_bytes"), F.min("page_id").alias("first_page"), F.count("*").alias("copies"), F.any_value("frame").alias("frame"),
        (F.min(check) != F.max(check)).alias("differs"), F.max("payload_bytes").alias("longest"),
    )
    clash = F.col("differs") | (F.col("longest") != F.col("payload_bytes"))
    payloads = payloads.select("digest", F.when(clash, F.raise_error(F.lit("payloads with equal digests differ")).cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "first_page", "copies", "frame")
    payloads, _ = write_table(payloads, compression="uncompressed")
    first = payloads.select("digest", "first_page", "copies")
    shared = (F.col("payload_bytes") >= least_shared) & F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    headers = digests.drop("html").join(first, "digest").withColumn("record_type", F.when(shared, "revisit").otherwise("response"))
    headers, _ = write_table(headers.select(_header().alias("header"), "digest", "copies"))
    return Archive(headers, payloads)


_FIELDS = "page_id long, record_type string, refers_to long, url string, header binary, payload binary"


def _reconstructed(batches):
    """Parses the exact headers, puts each record together and checks its payload against the header's digest."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    number = lambda x: None if x is None or x == "null" else int(x)
    last, payload = None, b""
    for batch in batches:
        rows: dict[str, list] = {x.split()[0]: [] for x in _FIELDS.split(", ")}
        held = 0
        for header, frame in zip(batch.column("header").to_pylist(), batch.column("frame"), strict=True):
            fields = dict(x.split(": ", 1) for x in header.decode().split("\r\n")[1:] if x)
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if digest != last:
                payload, last = unpack(frame.as_buffer()), digest
                if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["WARC-Payload-Length"]):
                    raise ValueError(f"stored payload {digest} is damaged")
            uri = fields.get("WARC-Target-URI")
            for name, value in zip(rows, (number(fields["WARC-Record-ID"][10:-1]), fields["WARC-Type"], number(fields["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in fields else None, uri, header, payload), strict=True):
                rows[name].append(value)
            held += len(payload)
            if held > 8 << 20:
                yield _batch(rows)
                rows, held = {k: [] for k in rows}, 0
        yield _batch(rows)


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def read_archive(archive: Archive) -> DataFrame:
    """The original records: (page_id, record_type, refers_to, url, header, payload), the payload whole for revisits too.

    Headers join payloads by digest. A digest with many records is salted: its frame is repeated once per
    ``RECORDS_PER_COPY`` records and its headers are dealt over the repetitions.
    """
    salts = F.ceil(F.col("copies") / RECORDS_PER_COPY)
    headers = archive.headers.select("header", "digest", F.pmod(F.xxhash64("header"), salts).alias("salt"))
    payloads = archive.payloads.select("digest", "frame", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    return headers.join(payloads, ["digest", "salt"]).select("header", "frame").transform(map_arrow, _reconstructed, _FIELDS)


def op10_warc_archive(spark, sf_dir: str) -> DataFrame:
    records = read_archive(write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d),
r AS (SELECT *, payload_bytes >= 100 AND first_page IS NOT NULL AND page_id IS DISTINCT FROM first_page AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_page END AS refers_to
FROM r
"""
