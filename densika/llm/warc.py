"""WARC writing, and reading with segment reassembly (operator 9).

write() stores each page as a WARC/1.1 record in gzip files. Payloads of REVISIT_BYTES and more that are equal are kept
once: the page with the smallest id gets a response record, the others revisit records. The HTTP body is in chunked
transfer coding, and blocks longer than ``segment_bytes`` are split: a first record and continuation records that name
its id as their origin. read() parses the files by their content lengths, groups segments by origin, orders them by
number, checks that none is missing and that the lengths add up to the total, and decodes the chunked framing.

Files go to a folder that all executors share, by Spark's own writer and reader, so any store will do and a lost
executor loses nothing. Which page comes first is found on narrow rows (id, digest, length), pre-aggregated before the
shuffle; payloads are shuffled once, by page id and digest, so a payload that a third of all pages have meets in no one
task. Only segments are shuffled when reading; a group holds one page.

Defined results: a null payload is empty; every row is a record, also where rows agree in all columns. Records of rows that
agree in page id and payload are of the same type and have numbers in their names; a revisit then names what they have in
common. Rows that share an id but not a payload are pages of their own; a null id comes after all others; payloads shorter than REVISIT_BYTES are never
revisited; pages of any length are segmented; an empty table gives an empty table; columns other than id, url and
payload are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 100
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: A file holds so many records at most, so a reading task holds about RECORDS_PER_FILE * SEGMENT_BYTES bytes of it.
RECORDS_PER_FILE = 2048
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0" + END


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            body.index(b"\r\n", at)  # trailers, if any, end with an empty line
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += size + 2


def record(kind: str, key: str, block: bytes, **more: object) -> bytes:
    """A record without the two line ends that close it; names in more are headers, with _ for -."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{key}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in more.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block


def records(key: str, url: str, payload: bytes, digest: str, size: int, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """All records of one page. payload is not read for a revisit."""
    url = re.sub(r"[\x00-\x20]", "%20", url)
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    about = {"WARC_Target_URI": url, "WARC_Payload_Digest": f"sha256:{digest}", "Content_Type": "application/http;msgtype=response"}
    if refers_to is not None:
        block = f"{head}Content-Length: {size}\r\n\r\n".encode()
        yield record("revisit", key, block, **about, WARC_Profile=PROFILE, WARC_Refers_To=f"<{refers_to}>", WARC_Truncated="length")
        return
    block = f"{head}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    if len(block) <= segment_bytes:
        yield record("response", key, block, **about)
        return
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    yield record("response", key, parts[0], **about, WARC_Segment_Number=1)
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        more = {"WARC_Segment_Origin_ID": f"<{key}>", "WARC_Segment_Number": n, "WARC_Segment_Total_Length": total}
        yield record("continuation", f"{key}/{n}", part, WARC_Target_URI=url, **more)


def write(pages: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the archive of the pages into a new folder."""
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload").cast("long")})
    rows = rows.withColumn("page", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "digest"))
    narrow = rows.select("page", "id", "digest", "size")
    first = narrow.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    own = narrow.groupBy("page", "id", "digest").agg(F.count("*").alias("times")).join(first, "digest", "left")
    own = own.select("page", "times", F.when(revisit, F.col("first")).alias("first"))
    joined = rows.join(own, "page").withColumn("payload", F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    number = F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"))
    page = joined.withColumn("number", F.when(F.col("times") > 1, number).otherwise(""))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                to = None if r["first"] is None else f"urn:page:{r['first']}:{r['digest']}"
                out += records(f"urn:page:{r['id']}:{r['digest']}{r['number']}", r["url"] or "", r["payload"], r["digest"], r["size"], to, segment_bytes)
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    text = page.mapInArrow(rendered, "record binary").select(F.col("record").cast("string"))
    writer = text.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.mode("errorifexists").text(folder)


def inflated(data: bytes) -> bytes:
    """The contents of gzip members one after another; other data as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data
    return b"".join(out) if out else data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and block of each record of a file."""
    data, at = inflated(data), 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(END, at)
        headers = {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, v in HEADER.findall(data, at, end)}
        first, size = end + len(END), int(headers["content-length"])
        block, at = data[first : first + size], first + size
        if len(block) != size or data[at : at + len(END)] != END:
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, block
        at += len(END)


def body(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and decoded payload of a block."""
    end = block.index(END)
    headers = {k.decode().strip().lower(): v.decode("latin-1").strip() for k, v in HEADER.findall(block, block.index(b"\r\n"), end)}
    data = block[end + len(END) :]
    return headers, dechunked(data) if headers.get("transfer-encoding", "").lower() == "chunked" else data


RECORD = "origin string, type string, refers_to string, url string, digest string, size long, number long, total long, block binary"
PAGE = "record_id string, type string, refers_to string, url string, declared_digest string, payload_bytes long, payload_digest string, complete boolean"


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row for each page of the archive, put together from its segments; complete is false where some are missing."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out = []
                for headers, block in parse(content.as_py()):
                    key = headers.get("warc-segment-origin-id", headers["warc-record-id"])[1:-1]
                    number = int(headers.get("warc-segment-number", 0))
                    digest, size = headers.get("warc-payload-digest", "").removeprefix("sha256:"), None
                    refers_to = headers.get("warc-refers-to", "<>")[1:-1] or None
                    if headers["warc-type"] == "revisit":
                        size, block = int(body(block)[0]["content-length"]), None
                    elif not number and not with_payload:  # whole: only its digest goes on
                        payload = body(block)[1]
                        size, block = len(payload), None
                        digest = f"{digest} {hashlib.sha256(payload).hexdigest()}"
                    total = headers.get("warc-segment-total-length")
                    out.append((key, headers["warc-type"], refers_to, headers.get("warc-target-uri"), digest or None, size, number, total and int(total), block))
                yield batch_of(out, RECORD)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                declared, _, digest = (r["digest"] or "").partition(" ")
                size, complete, payload = r["size"], True, None
                if r["type"] == "revisit":
                    digest = declared
                elif any(p["block"] is not None for p in r["parts"]):
                    block = b"".join(p["block"] for p in sorted(r["parts"], key=lambda p: p["number"]))
                    numbers = sorted(p["number"] for p in r["parts"])
                    complete = numbers in ([0], list(range(1, len(numbers) + 1))) and r["total"] in (None if numbers == [0] else len(block), len(block))
                    if complete:
                        payload = body(block)[1]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                complete = complete and declared == digest
                row = (r["origin"], r["type"], r["refers_to"], r["url"], declared, size, digest if complete else None, complete)
                out.append((*row, payload) if with_payload else row)
            yield batch_of(out, schema)

    schema = PAGE + ", payload binary" * with_payload
    files = spark.read.format("binaryFile").load(folder).select("content")
    found = files.mapInArrow(parsed, RECORD)
    head = F.col("type") != "continuation"
    merged = found.groupBy("origin").agg(
        *(F.max(F.when(head, F.col(c))).alias(c) for c in ("type", "refers_to", "url", "digest", "size")),
        F.max("total").alias("total"), F.collect_list(F.struct("number", "block")).alias("parts"),
    )
    return merged.mapInArrow(joined, schema)


KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_pydict({name: pa.array(c, KINDS[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def page_id(column: str) -> F.Column:
    """The id in a record's name urn:page:<id>:<digest>; null where the page had none."""
    return F.expr(f"try_cast(split({column}, ':')[2] AS bigint)")
