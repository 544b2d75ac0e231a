"""WARC archives: write pages as records, read the archives back.

Writing. Payloads of at least MIN_REVISIT_BYTES that occur more than once have
one response, the page of the smallest id; the other pages revisit it. Response
payloads travel in chunked transfer framing. A record block longer than a
segment goes on in continuation records, which carry the origin's identifier
and a segment number, the last one also the total length. Archives are written
by Spark's own text sink, a record a row, so any store that Spark reaches will
do; the line separator is the blank lines that end a record.

Reading. Archives are split into records by their lengths. Segments group by
origin identifier, go in order of segment number, and must add up to the total
length; only records that have continuations are grouped. Then the HTTP head is
taken off, the chunked framing decoded and the digest computed and compared.

Defined cases: a null html is an empty payload; a null page id comes after all
others and is written as an absent field; repeated rows of the smallest id are
responses alike; an empty table writes no record and gives an empty result;
other columns are ignored; white space in a URL is left out of the record's
target, and a page without a URL has about:blank there. A damaged record raises
an error.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import Workspace

MIN_REVISIT_BYTES = 100
SEGMENT_BYTES = 65_536
CHUNK_BYTES = 8_192
RECORDS_PER_FILE = 1_000
BROADCAST_DIGESTS = 500_000
END = "\r\n\r\n"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "1970-01-01T00:00:00Z"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_RECORD = pa.schema(
    [
        ("kind", pa.string()),
        ("record_id", pa.string()),
        ("origin_id", pa.string()),
        ("segment", pa.int64()),
        ("total_length", pa.int64()),
        ("page_id", pa.int64()),
        ("digest", pa.string()),
        ("refers_to", pa.int64()),
        ("block", pa.binary()),
    ]
)
_RECORD_DDL = (
    "kind string, record_id string, origin_id string, segment bigint, total_length bigint, "
    "page_id bigint, digest string, refers_to bigint, block binary"
)


def _cut(data: bytes, start: int, size: int) -> int:
    """End of a slice of at most size bytes that splits no character."""
    end = min(start + size, len(data))
    while end < len(data) and end > start + 1 and data[end] & 0xC0 == 0x80:
        end -= 1
    return end


def chunked(data: bytes, size: int = CHUNK_BYTES) -> bytes:
    out, at = [], 0
    while at < len(data):
        end = _cut(data, at, size)
        out += [b"%x\r\n" % (end - at), data[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The bytes that chunked framing carries; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        size = int(data[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends too early")
        out.append(data[at : at + size])
        at += size + 2


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", _DATE), *fields]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n{block.decode()}"


def records_of(url: str | None, page_id: int | None, payload: bytes, digest: str, first: int | None, revisit: bool, nth: int, segment: int) -> Iterator[str]:
    """The records of one page: a response and its continuations, or a revisit."""
    own = str(uuid.uuid5(_NAMES, f"{page_id}:{digest}:{nth}"))
    clean = "".join((url or "").split()) or "about:blank"
    fields = [("WARC-Target-URI", clean)] + ([("Page-ID", str(page_id))] if page_id is not None else [])
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", str(first))]
        yield _record("revisit", own, [*fields, ("Content-Type", "application/http; msgtype=response")], _HEAD)
        return
    block, at, number = _HEAD + chunked(payload), 0, 1
    fields.append(("Content-Type", "application/http; msgtype=response"))
    while at < len(block) or number == 1:
        end = _cut(block, at, segment)
        part = [("WARC-Segment-Number", str(number))] if len(block) > segment else []
        if number == 1:
            yield _record("response", own, fields + part, block[at:end])
        else:
            part.append(("WARC-Segment-Origin-ID", f"<urn:uuid:{own}>"))
            part += [("WARC-Segment-Total-Length", str(len(block)))] if end == len(block) else []
            yield _record("continuation", str(uuid.uuid5(_NAMES, f"{own}:{number}")), part, block[at:end])
        at, number = end, number + 1


def _planned(pages: DataFrame, space: Workspace) -> DataFrame:
    """page_id, url, html, digest, first (page that a payload's copies revisit) and revisit."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = F.octet_length("html") >= MIN_REVISIT_BYTES
    groups = base.filter(long).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    groups = space.keep(groups.filter("n > 1").select("digest", "first", "n"), "copies")
    sums = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("pages")).first()
    # Payloads of a BROADCAST_DIGESTS-th of all copies or more are broadcast at any size, so no task gets all copies of one.
    often = F.col("n") * BROADCAST_DIGESTS >= (sums["pages"] or 0)
    many = sums["groups"] > BROADCAST_DIGESTS
    hot, cold = (groups.filter(often), groups.filter(~often)) if many else (groups, None)
    joined = base.join(F.broadcast(hot.select("digest", "first")), "digest", "left")
    if cold is not None:
        rest = joined.filter(F.col("first").isNull() & long).drop("first").join(cold.select("digest", "first"), "digest", "left")
        joined = joined.filter(F.col("first").isNotNull() | ~long).unionByName(rest)
    return joined.withColumn("revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Writes gzipped archives of bounded numbers of records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for b in batches:
            rows = zip(*[b.column(i).to_pylist() for i in (0, 1)], b.column(2).cast(pa.binary()).to_pylist(), *[b.column(i).to_pylist() for i in (3, 4, 5)], strict=True)
            out, size = [], 0
            for page_id, url, payload, digest, first, revisit in rows:
                nth += 1
                for r in records_of(url, page_id, payload, digest, first, revisit, nth, segment):
                    out.append(r)
                    size += len(r)
                if size > 4_000_000:
                    yield pa.record_batch([pa.array(out, pa.string())], ["value"])
                    out, size = [], 0
            yield pa.record_batch([pa.array(out, pa.string())], ["value"])

    planned = _planned(pages, Workspace(pages.sparkSession, "warc-plan")).select("page_id", "url", F.expr("if(revisit, '', html)").alias("html"), "digest", "first", "revisit")
    lines = planned.mapInArrow(write, "value string")
    lines.write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:head_end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        start = head_end + 4
        end = start + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"a record at byte {at} ends too early")
        yield fields, data[start:end]
        at = end + 4


def archive_bytes(content: bytes) -> bytes:
    """An archive's records: all members of a gzip file, or the bytes of a plain one."""
    if not content.startswith(b"\x1f\x8b"):
        return content
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as members:
        return members.read()


def _bare(identifier: str | None) -> str | None:
    return identifier[len("<urn:uuid:") : -1] if identifier else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for f, block in parse(archive_bytes(content.as_py())):
                    rows.append(
                        (f["WARC-Type"], _bare(f["WARC-Record-ID"]), _bare(f.get("WARC-Segment-Origin-ID")), number(f.get("WARC-Segment-Number")),
                         number(f.get("WARC-Segment-Total-Length")), number(f.get("Page-ID")), f.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
                         number(f.get("WARC-Refers-To-Page")), block)
                    )
                    size += len(block)
                    if size > 4_000_000:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), _RECORD.types)], schema=_RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), _RECORD.types)], schema=_RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    return files.mapInArrow(read, _RECORD_DDL)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole response blocks to page id, payload size and checked digest."""
    for b in batches:
        out = []
        for page_id, digest, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            head, _, body = block.partition(b"\r\n\r\n")
            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            found = hashlib.sha256(payload).hexdigest()
            if digest and digest != found:
                raise ValueError(f"the payload of page {page_id} does not match its digest")
            out.append((page_id, len(payload), found))
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["page_id", "payload_bytes", "payload_digest"])


def reassembled(records: DataFrame) -> DataFrame:
    """page_id, digest, block: segments in order, lengths verified."""
    whole = records.filter((F.col("kind") == "response") & F.col("segment").isNull()).select("page_id", "digest", "block")
    parts = records.filter(F.col("segment").isNotNull() & F.col("kind").isin("response", "continuation"))
    piece = F.struct("segment", "block")
    joined = parts.groupBy(F.coalesce("origin_id", "record_id").alias("origin")).agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"),
        F.max("total_length").alias("total"),
        F.max("page_id").alias("page_id"),
        F.max("digest").alias("digest"),
    )
    block = F.unhex(F.array_join(F.transform("pieces", lambda x: F.hex(x["block"])), ""))
    gap = F.raise_error(F.concat(F.lit("segments missing of record "), F.col("origin"))).cast("binary")
    in_order = (F.element_at("pieces", -1)["segment"] == F.size("pieces")) & (F.element_at("pieces", 1)["segment"] == 1)
    joined = joined.withColumn("_b", block)
    checked = F.when(in_order & (F.octet_length("_b") == F.col("total")), F.col("_b")).otherwise(gap)
    return whole.unionByName(joined.select("page_id", "digest", checked.alias("block")))


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Responses and revisits of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = read_records(spark, path)
    responses = reassembled(records).mapInArrow(_assembled, "page_id bigint, payload_bytes bigint, payload_digest string")
    responses = responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("bigint")})
    revisits = records.filter("kind = 'revisit'").select("page_id", F.col("digest").alias("payload_digest"), "refers_to")
    return responses, revisits


def archive_round_trip(pages: DataFrame, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Writes the pages' archives, reads them back, and resolves revisits.

    A revisit's payload is its response's, found by digest: the sizes of
    revisited payloads, one row each, join the revisits.
    """
    spark = pages.sparkSession
    space = Workspace(spark, "warc")
    write_archives(pages, f"{space.path}/archives", segment)
    responses, revisits = read_pages(spark, f"{space.path}/archives")
    responses = space.keep(responses, "responses")
    revisits = space.keep(revisits, "revisits")
    wanted = revisits.groupBy("payload_digest").agg(F.count("*").alias("n"))
    sizes = responses.join(wanted, "payload_digest").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("n").alias("n"))
    sizes = space.keep(sizes, "sizes")
    sums = sizes.agg(F.count("*").alias("groups"), F.sum("n").alias("pages")).first()
    often = F.lit(sums["groups"] <= BROADCAST_DIGESTS) | (F.col("n") * BROADCAST_DIGESTS >= (sums["pages"] or 0))
    resolved = revisits.join(F.broadcast(sizes.filter(often).drop("n")), "payload_digest", "left")
    if sums["groups"] > BROADCAST_DIGESTS:
        rest = resolved.filter("payload_bytes is null").drop("payload_bytes").join(sizes.drop("n"), "payload_digest", "left")
        resolved = resolved.filter("payload_bytes is not null").unionByName(rest)
    return responses.unionByName(resolved.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
