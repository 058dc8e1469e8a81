"""WARC archives: writing with segments and chunked framing, and reassembly.

Writing and reading go through Spark's own file writers and readers, so archives may lie in any store
Spark reaches. A record's block (HTTP header and chunked body) longer than ``segment_bytes`` is cut into
a first record and continuation records, so a file's size is bounded by records * segment size. On
reading, whole records are decoded where they are found; only segments are shuffled, grouped by the identifier of
their origin, ordered by segment number, verified against the total length and then decoded.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import materialize

_CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_SCHEMA = "record_id string, page_id bigint, url string, record_type string, refers_to bigint, refers_to_id string, digest string, segment int, total bigint, block binary, problem string"


def _bytes(text: Column) -> Column:
    return F.encode(text, "utf-8")


def chunked(payload: Column, chunk_bytes: int) -> Column:
    """The payload in chunked transfer framing, with its closing empty chunk."""
    starts = F.when(F.length(payload) > 0, F.sequence(F.lit(1), F.length(payload), F.lit(chunk_bytes))).otherwise(F.array().cast("array<int>"))
    part = lambda i: F.substring(payload, i, F.lit(chunk_bytes))
    framed = F.transform(starts, lambda i: F.concat(_bytes(F.concat(F.lower(F.hex(F.least(F.length(payload) - i + 1, F.lit(chunk_bytes)).cast("bigint"))), F.lit(_CRLF))), part(i), _bytes(F.lit(_CRLF))))
    return F.concat(F.aggregate(framed, _bytes(F.lit("")), lambda a, b: F.concat(a, b)), _bytes(F.lit("0\r\n\r\n")))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 1000, segment_bytes: int = 32768, chunk_bytes: int = 8192, records_per_file: int = 4096) -> None:
    """Write a WARC record per row of pages (page_id, url, html) under path; html null: empty payload.

    Of rows with equal payloads of at least min_revisit_bytes bytes, the one with the largest page_id is
    a response and the others revisit it; ties for the largest are all responses, and null page_ids are
    smaller than any. All other rows are responses. Line ends in a url are written as blanks. Extra columns are not written.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"), F.col("url").isNull().alias("no_url"), _bytes(F.coalesce("html", F.lit(""))).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    rows = rows.withColumn("record_id", F.regexp_replace(F.md5(_bytes(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "url", "digest"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "urn:uuid:$1-$2-$3-$4-$5"))
    large = rows.filter(F.col("bytes") >= min_revisit_bytes).select("digest", "bytes", "page_id", "record_id")
    heads = large.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "record_id")).alias("head")).filter("n > 1 and head.page_id is not null")
    # only what revisits another row is joined back, by row, so that no digest is hot
    repeats = large.join(heads, ["digest", "bytes"]).filter("page_id is null or page_id < head.page_id").groupBy("record_id").agg(F.first("head.page_id").alias("to_page"), F.first("head.record_id").alias("to_id"))
    rows = rows.join(repeats, "record_id", "left")
    revisit = F.col("to_id").isNotNull()
    body = F.when(revisit, _bytes(F.lit(_HTTP + _CRLF))).otherwise(F.concat(_bytes(F.lit(_HTTP + "Transfer-Encoding: chunked\r\n\r\n")), chunked(F.col("payload"), chunk_bytes)))
    rows = rows.withColumn("block", body).withColumn("size", F.length("block")).withColumn("start", F.explode(F.sequence(F.lit(0), F.length("block") - 1, F.lit(segment_bytes))))
    number = (F.col("start") / segment_bytes).cast("int") + 1
    first, last, alone = F.col("start") == 0, F.col("start") + segment_bytes >= F.col("size"), F.col("size") <= segment_bytes
    line = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_CRLF))).otherwise(F.lit(""))
    piece = F.substring(F.col("block"), F.col("start") + 1, F.lit(segment_bytes))
    own = F.concat(F.lit("<"), F.col("record_id"), F.when(first, F.lit("")).otherwise(F.concat(F.lit("/"), number.cast("string"))), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("url"), first & ~F.col("no_url")),
        line("X-Page-ID", F.col("page_id"), first & F.col("page_id").isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), first & revisit),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("to_id"), F.lit(">")), first & revisit),
        line("X-Refers-To-Page-ID", F.col("to_page"), first & revisit),
        line("WARC-Segment-Number", number, ~alone),
        line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">")), ~first),
        line("WARC-Segment-Total-Length", F.col("size"), last & ~alone),
        line("Content-Type", F.lit("application/http; msgtype=response"), first),
        line("Content-Length", F.length(piece)),
        F.lit(_CRLF),
    )
    # each record ends with two line ends: the writer's line separator
    text = F.concat(_bytes(header), piece).cast("string")
    rows.select(text.alias("value")).write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _dechunk(body: bytes) -> tuple[bytes | None, str | None]:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or end + 2 + n + 2 > len(body) or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None, "broken chunk"
        if not n:
            return b"".join(out), None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def http_payload(block: bytes) -> tuple[bytes | None, str | None]:
    """(payload, problem) of an HTTP response, its body's chunked framing decoded where its header names that."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None, "no end of HTTP header"
    if b"\r\ntransfer-encoding: chunked" in head.lower():
        return _dechunk(body)
    return body, None


def _unzipped(data: bytes) -> tuple[bytes, str | None]:
    out, problem = [], None
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as members:
        try:
            while piece := members.read1(1 << 20):
                out.append(piece)
        except (OSError, EOFError, zlib.error):
            problem = "broken gzip"
    return b"".join(out), problem


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header fields by lower-case name, block, problem) of each record of a file, which may be gzip members.

    What is no record gives one row without fields, and reading goes on at the next line that opens one. A record that the
    file's end cuts off is the last. Of broken gzip members what can be read is read.
    """
    if data[:2] == b"\x1f\x8b":
        data, broken = _unzipped(data)
        if broken:
            yield {}, b"", broken
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else []
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines or not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            yield {}, b"", "not a WARC record"
            at = data.find(b"\nWARC/", at) + 1
            if not at:
                return
            continue
        stop = end + 4 + int(fields["content-length"])
        yield fields, data[end + 4 : stop], None if stop <= len(data) else "cut off"
        at = stop + 4


def read_warc(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """One row per record of the archives under path whose names fit the pattern ``files``: record_id, page_id, url, record_type, refers_to, digest, payload, problem.

    Continuations are grouped by origin identifier, ordered by number, and their joint length is verified;
    a record that is cut off, lacks a segment, has another length than stated or broken framing has a
    null payload and says so in problem; so do an origin whose first segment is missing, a continuation without a number,
    and what is no record. Records written twice under one identifier give two rows;
    repeated continuations count once. A revisit has a null payload; refers_to is the page it
    repeats. An empty folder gives no rows.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "page_id", "url", "record_type", "refers_to", "refers_to_id", "digest", "segment", "total", "block", "problem"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for f, block, problem in _records(data.as_py()):
                    number = lambda name, f=f: int(f[name]) if f.get(name, "").lstrip("-").isdigit() else None
                    origin = f.get("warc-segment-origin-id") or f.get("warc-record-id", "")
                    rows.append((origin.strip("<>"), number("x-page-id"), f.get("warc-target-uri"), f.get("warc-type"), number("x-refers-to-page-id"), f.get("warc-refers-to", "").strip("<>") or None, f.get("warc-payload-digest", "").removeprefix("sha1:") or None, number("warc-segment-number"), number("warc-segment-total-length"), block, problem))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, problems = batch.column("block").to_pylist(), batch.column("problem").to_pylist()
            done = [(None, p) if p or b is None else http_payload(b) for b, p in zip(blocks, problems)]
            out = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*out, pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=[*batch.schema.names[:-2], "payload", "problem"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("content").mapInArrow(parse, _SCHEMA)
    kept = ["record_id", "page_id", "url", "record_type", "refers_to", "refers_to_id", "digest"]
    stray = F.when(F.col("record_type") == "continuation", F.lit("no segment number"))
    whole = found.filter("segment is null").select(*kept, F.when(F.col("record_type") != "revisit", F.col("block")).alias("block"), F.coalesce("problem", stray).alias("problem"))
    first = F.col("segment") == 1
    parts = found.filter("segment is not null").groupBy("record_id").agg(
        *(F.max(F.when(first, F.col(c))).alias(c) for c in kept[1:]),
        F.sum(first.cast("int")).alias("copies"),
        F.max("total").alias("total"),
        F.max("problem").alias("problem"),
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("segments"),
    )
    numbers, joined = F.transform("segments", lambda s: s["segment"]), F.aggregate("segments", F.encode(F.lit(""), "utf-8"), lambda a, s: F.concat(a, s["block"]))
    parts = parts.withColumn("numbered", numbers).withColumn("block", joined)
    problem = F.coalesce("problem", F.when(F.col("numbered") != F.sequence(F.lit(1), F.size("numbered")), F.lit("segment missing")), F.when(~F.col("total").eqNullSafe(F.length("block").cast("bigint")), F.lit("wrong total length")))
    parts = parts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int")))).select(*kept, "block", problem.alias("problem"))
    schema = "record_id string, page_id bigint, url string, record_type string, refers_to bigint, refers_to_id string, digest string, payload binary, problem string"
    return whole.unionByName(parts).mapInArrow(decode, schema)


def archived(spark: SparkSession, path: str) -> DataFrame:
    """read_warc's records with payload_bytes and payload_digest of the full payload; a revisit has those of the response it names."""
    records = read_warc(spark, path).withColumn("payload_bytes", F.length("payload").cast("bigint")).withColumn("payload_digest", F.sha1("payload"))
    records = materialize(records.drop("payload"), "records")
    full = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    wanted = records.filter("record_type = 'revisit'").select("refers_to_id").distinct()
    full = full.join(wanted, "refers_to_id", "left_semi").dropDuplicates(["refers_to_id"])
    # only revisits have a key to join by; all else would meet under the key null
    again = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    none = {c: F.lit(None).cast(full.schema[c].dataType) for c in ("full_bytes", "full_digest")}
    out = records.filter(again).join(full, "refers_to_id", "left").unionByName(records.filter(~again).withColumns(none))
    return out.select("record_id", "page_id", "url", "record_type", "refers_to", "digest", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "full_digest").alias("payload_digest"), "problem")
