"""WARC archives: writing captures, reading records, and joining records to captures."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskmill.llm.common import text_bytes
from taskmill.llm.url_templates import host_of, path_of
from taskmill.scale import lookup, stage

# Equal payloads below this size are stored each; the others once, with revisits.
MIN_SHARED = 100
# An archive file holds about this many bytes of payload before it is compressed.
FILE_BYTES = 16 * 1024 * 1024
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def _record_id(*parts: Column) -> Column:
    key = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(key, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: Column, headers: dict[str, Column], content_type: Column, block: Column) -> Column:
    """One record up to the blank lines that end it; a header with a null value is left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers.items()]
    lines += [F.concat(F.lit("Content-Type: "), content_type),
              F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


def with_first_holders(pages: DataFrame, page_id: str, payload: Column) -> DataFrame:
    """Add ``__payload``, ``__bytes``, ``__digest`` and ``__first``, the smallest id with this payload.

    Only digests that several pages share make up the looked-up table, so payloads rarely move.
    """
    rows = pages.withColumn("__payload", F.coalesce(payload, F.lit(""))).withColumns({
        "__bytes": F.octet_length("__payload").cast("long"), "__digest": F.sha2("__payload", 256),
    })
    shared = rows.where(F.col("__bytes") >= MIN_SHARED).groupBy("__digest").agg(
        F.min(page_id).alias("__first"), F.count(F.lit(1)).alias("__n")
    ).where("__n > 1 and __first is not null").drop("__n")
    return lookup(rows, shared.checkpoint(), ["__digest"])


def write_warc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
    date: str = DATE, file_bytes: int = FILE_BYTES,
) -> None:
    """Write a response or revisit, a request and a metadata record per page as gzip WARC files.

    Of pages with equal payloads of at least ``MIN_SHARED`` bytes those with the smallest id are
    responses, the others revisits without a payload (a null id counts as the largest). A null payload
    is empty, a null url is left out, line breaks in a url become spaces. Pages that repeat, ids included,
    are records each, with one record id; a very long payload is one record. An empty table makes archives
    without records; other columns are not read, whatever their names.
    """
    rows = with_first_holders(pages.select(page_id, url, payload), page_id, F.col(payload))
    one, first = F.col(page_id), F.col("__first")
    revisits = first.isNotNull() & (one.isNull() | (one > first))
    target = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", " ")
    identity = _record_id(F.lit("response"), one, F.col("__digest"))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("__bytes").cast("string"), F.lit(END + END),
    )
    ask = F.concat(
        F.lit("GET "), F.when(path_of(target) == "", "/").otherwise(path_of(target)),
        F.lit(f" HTTP/1.1{END}Host: "), host_of(target), F.lit(END + END),
    )
    fields = F.concat(F.lit("page_id: "), F.coalesce(one.cast("string"), F.lit("")), F.lit(END))
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": F.when(F.col(url).isNotNull(), target)}
    to_response = {"WARC-Concurrent-To": identity}
    captured = _record(
        F.when(revisits, "revisit").otherwise("response"),
        {"WARC-Record-ID": identity, **common,
         "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("__digest")),
         "WARC-Profile": F.when(revisits, REVISIT),
         "WARC-Refers-To": F.when(revisits, _record_id(F.lit("response"), first, F.col("__digest")))},
        F.lit("application/http;msgtype=response"),
        F.when(revisits, head).otherwise(F.concat(head, F.col("__payload"))),
    )
    request = _record(
        F.lit("request"), {"WARC-Record-ID": _record_id(F.lit("request"), one, F.col("__digest")), **common, **to_response},
        F.lit("application/http;msgtype=request"), ask,
    )
    metadata = _record(
        F.lit("metadata"), {"WARC-Record-ID": _record_id(F.lit("metadata"), one, F.col("__digest")), **common, **to_response},
        F.lit("application/warc-fields"), fields,
    )
    count = pages.count()
    mean = text_bytes(pages, payload) / max(1, count) + 1000
    rows.select(F.explode(F.array(captured, request, metadata)).alias("value")).write.option(
        "lineSep", END + END
    ).option("compression", "gzip").option("maxRecordsPerFile", 3 * max(1, int(file_bytes / mean))).text(path)


RECORDS = (
    "record_id string, type string, date string, target_uri string, concurrent_to string, refers_to string, "
    "payload_digest string, payload_bytes bigint, computed_digest string, fields map<string,string>, payload binary"
)


def parsed_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {headers.get('warc-record-id')} ends early")
        yield headers, block


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind, payload, stated, fields = headers.get("warc-type"), None, None, None
    if kind in ("response", "revisit", "request"):
        head, _, payload = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                stated = int(value)
    elif kind == "metadata":
        pairs = (line.partition(":") for line in block.decode("utf-8", "replace").splitlines() if line)
        fields = [(name.strip(), value.strip()) for name, _, value in pairs]
    else:
        payload = block
    full = kind != "revisit" and payload is not None
    return {
        "record_id": headers.get("warc-record-id"), "type": kind, "date": headers.get("warc-date"),
        "target_uri": headers.get("warc-target-uri"), "concurrent_to": headers.get("warc-concurrent-to"),
        "refers_to": headers.get("warc-refers-to"),
        "payload_digest": (headers.get("warc-payload-digest") or "").rpartition(":")[2] or None,
        "payload_bytes": len(payload) if full else stated,
        "computed_digest": hashlib.sha256(payload).hexdigest() if full else None,
        "fields": fields, "payload": payload if full and with_payload else None,
    }


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of plain or gzip WARC files, whole or with a gzip member per record.

    A file is read by one task, record by record; malformed archives raise. ``payload_bytes`` of a
    revisit is what its HTTP header states, ``computed_digest`` is taken from the payload itself.
    """
    schema = pa.schema([
        *[(name, pa.string()) for name in ("record_id", "type", "date", "target_uri", "concurrent_to", "refers_to",
                                           "payload_digest")],
        ("payload_bytes", pa.int64()), ("computed_digest", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                raw = io.BytesIO(data)
                packed = bytes(data[:2]) == b"\x1f\x8b"
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if packed else raw
                rows, size = [], 0
                for headers, block in parsed_records(stream):
                    rows.append(_row(headers, block, with_payload))
                    size += len(block) if with_payload else 0
                    if len(rows) >= 4000 or size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture (response or revisit) with its request and metadata nested.

    Requests and metadata name their response in WARC-Concurrent-To. Of several of a kind the one with
    the smallest record id is nested, ``n_requests`` and ``n_metadata`` count all; a capture without one
    has null there. Records without a capture fall out. Captures with one record id stay apart.
    """
    def beside(kind: str) -> DataFrame:
        nested = F.struct("record_id", "date", "target_uri", "payload_bytes", "fields")
        return records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(
            F.col("concurrent_to").alias("record_id")
        ).agg(F.min_by(nested, "record_id").alias(kind), F.count(F.lit(1)).alias(f"__n_{kind}"))

    captures = records.where(F.col("type").isin("response", "revisit")).select(
        "record_id", "type", "date", "target_uri", "refers_to", "payload_digest", "payload_bytes",
        "computed_digest", "payload",
    )
    none = F.lit(0).cast("long")
    return captures.join(beside("request"), "record_id", "left").join(beside("metadata"), "record_id", "left").select(
        *captures.columns, "request", "metadata",
        F.coalesce("__n_request", none).alias("n_requests"), F.coalesce("__n_metadata", none).alias("n_metadata"),
    )


def with_referred(captures: DataFrame, name: str) -> DataFrame:
    """Add to every revisit the metadata field ``name`` of the response it refers to, as ``referred``."""
    value = F.element_at("metadata.fields", F.lit(name)).alias("referred")
    narrow = stage(captures.select("record_id", "type", "refers_to", value), "references")
    wanted = narrow.select(F.col("refers_to").alias("record_id")).where("record_id is not null").distinct()
    of = narrow.where("type = 'response'").join(wanted, "record_id", "left_semi").groupBy(
        F.col("record_id").alias("refers_to")
    ).agg(F.min("referred").alias("referred"))
    # Revisits of one payload may be a large share of all; captures that refer to nothing do not move.
    return lookup(captures, stage(of, "referred"), ["refers_to"]).select(*captures.columns, "referred")
