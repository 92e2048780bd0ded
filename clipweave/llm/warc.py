"""WARC archives in the shared folder: revisit resolution by payload digest.

Archives are gzip text files written by Spark, whose line end is the blank line that closes a
WARC record, so a file is a plain sequence of records. Reading streams a file's parts through one
task and cuts records by Content-Length.

Defined cases: a null html is an empty payload; a null url is written as an empty target; rows
with a null page_id are stored as responses, never revisited, and come back with a null page_id;
rows repeated with the smallest page_id are all responses; payloads may hold blank lines or text
that looks like a record; extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.llm.common import spread_join, written
from clipweave.session import scratch_path

#: smaller payloads are never revisited; fixed by the result contract
MIN_PAYLOAD = 100
BREAK = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
FIELDS = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _record(kind: str, head: list[Column], block: Column) -> Column:
    """Text of one record without the blank line that closes it."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value)

    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", "%0D%0A")
    named = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.lit(kind)), line("WARC-Record-ID", named), line("WARC-Target-URI", url), line("WARC-Date", F.lit(DATE)),
        *[line(n, v) for n, v in head], line("Content-Length", F.octet_length(block).cast("string")), F.lit(BREAK), block,
    )


def response(payload: Column, digest: Column) -> Column:
    size = F.octet_length(payload).cast("string")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(BREAK), payload)
    return _record("response", [("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest))], block)


def revisit() -> Column:
    """A fresh header that names the original; the block is the HTTP head alone."""
    head = [
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        ("WARC-Truncated", F.lit("length")),
    ]
    return _record("revisit", head, F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + BREAK))


def write_archive(records: DataFrame, name: str) -> str:
    """Write one text column of records; returns the folder."""
    path = scratch_path(records.sparkSession, name)
    records.write.option("lineSep", BREAK).option("compression", "gzip").text(path)
    return path


def _records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record in a stream that lost its blank lines."""
    held, size, need, fields = [], 0, None, {}
    mark = BREAK.encode()
    for part in parts:
        held += [part, mark]
        size += len(part) + len(mark)
        while size and (need is None or size >= need):
            data = b"".join(held)
            if need is None:
                # a payload that ends in line ends leaves some of them before the next header
                data = data.lstrip(b"\r\n")
                if not data:
                    held, size = [], 0
                    break
                head, _, rest = data.partition(mark)
                lines = head.decode("utf-8").split("\r\n")
                fields = dict(x.split(": ", 1) for x in lines[1:])
                need = int(fields["Content-Length"]) + len(mark)
            else:
                yield fields, data[: need - len(mark)]
                rest, need = data[need:], None
            held, size = [rest] if rest else [], len(rest)
    if size or need is not None:
        raise ValueError("an archive ends inside a record")


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Headers of all records, digests and sizes taken anew from responses' payloads; ``payload`` adds it.

    A revisit has its digest from the header and no size: its payload is the original's.
    """

    def number(name: str) -> int | None:
        text = name.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for fields, block in _records(x for b in batches for x in b.column(0).to_pylist()):
            body = block.partition(mark)[2]
            kind = fields["WARC-Type"]
            digest = hashlib.sha256(body).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha256:")
            rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, number(fields.get("WARC-Refers-To", "")), len(body) if kind == "response" else None, digest, *[body.decode("utf-8")] * payload))
            held += len(body) if payload else 200
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    mark = BREAK.encode()
    names = [*FIELDS, *["payload"] * payload]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    text = spark.read.option("lineSep", BREAK).text(path)
    return text.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, SCHEMA + ", payload string" * payload)


def archive(pages: DataFrame) -> str:
    """Every page as a response record, before any are known to be equal."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    return write_archive(rows.select(response(F.col("payload"), F.sha2("payload", 256)).alias("value")), "warc-in")


def find_revisits(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, refers_to) of records whose payload an earlier page has; only headers are shuffled."""
    large = headers.filter((F.col("payload_bytes") >= min_payload) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    ends = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    shared = written(ends.filter("last > refers_to").drop("last"), "warc-shared")
    later = spread_join(large, shared, ["payload_digest"], F.col("page_id")).filter("page_id > refers_to")
    return later.select("page_id", "payload_digest", "refers_to").distinct()


def deduplicate(spark: SparkSession, path: str, min_payload: int = MIN_PAYLOAD) -> str:
    """Read archives, resolve revisits and write deduplicated ones; returns their folder."""
    revisits = written(find_revisits(read_archive(spark, path), min_payload), "warc-revisits")
    full = read_archive(spark, path, payload=True).drop("refers_to")
    joined = full.join(revisits, ["page_id", "payload_digest"], "left")
    record = F.when(F.col("refers_to").isNull(), response(F.col("payload"), F.col("payload_digest"))).otherwise(revisit())
    return write_archive(joined.select(record.alias("value")), "warc-out")


def resolve(spark: SparkSession, path: str) -> DataFrame:
    """Records of a deduplicated archive; a revisit has size and digest of the response it names."""
    headers = written(read_archive(spark, path), "warc-headers")
    revisits = headers.filter("record_type = 'revisit'").select("page_id", "url", "record_type", "refers_to", "payload_digest")
    named = revisits.select(F.col("refers_to").alias("page_id")).distinct()
    originals = headers.filter("record_type = 'response'").join(named, "page_id", "left_semi")
    originals = originals.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    found = spread_join(revisits, originals, ["refers_to", "payload_digest"], F.col("page_id")).select(*FIELDS)
    return headers.filter("record_type = 'response'").select(*FIELDS).unionByName(found)
