"""WARC archives by a converter of legacy archives.

Pages are written as ARC files (version 1 in every other task's files, version 2 in the rest), the converter parses the
version-specific header lines and declared lengths, of archives of other writers too, and synthesises WARC records:
identifiers, timestamps, types, digests. Files are gzipped text of Spark's own writer, whose line separator is the record
separator; the first record of a file carries the file's description. Records go to files by classes of size, each with a
most number of records to a file, so that no file, which a reader has as one value, is large whatever the sizes are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm.shared import delete, integral, removed, shared_path, ship, small_or_shuffled, stored, text_or_empty

#: Classes of payloads: bytes below which a class ends, and most records of its files. A larger payload has a file of its own.
CLASSES = ((64 << 10, 10_000), (4 << 20, 128))
BATCH_BYTES = 4 << 20

#: Payloads below it are never revisits.
LEAST_REVISIT = 1000

DATE = "20240101000000"

# Fixed values of the ARC format: the record definition of each version, for writing.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

# Fixed value of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CRLF = "\r\n"

CONTROLS = r"[\x00-\x20\x7F]+"


def classes(size: Column) -> Column:
    out = F.lit(len(CLASSES))
    for k, (below, _) in reversed(list(enumerate(CLASSES))):
        out = F.when(size < below, F.lit(k)).otherwise(out)
    return out


def records_of_file(class_: int) -> int:
    return CLASSES[class_][1] if class_ < len(CLASSES) else 1


def record_id(file: str, offset: int, url: str, date: str) -> str:
    """The same for a record in every reading: a name-based UUID of where it stands and what it says it is."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset} {url} {date}').urn}>"


def timestamp(date: str) -> str:
    """Of an ARC date of eight to fourteen digits."""
    if not re.fullmatch("[0-9]{8,}", date):
        raise ValueError(f"not an ARC date: {date!r}")
    d = date[:14].ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


# Writing ARC.

def first_of_file(records: int) -> Column:
    """Whether a row is the first of its file; for the projection right before a write of so many records a file."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % records == 0


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> None:
    """An ARC record per row, in a folder a class of size: an HTTP response whose body is the html.

    Null html is an empty body; white space and controls in a url become %20, an empty or null one is "unknown:".
    """
    integral(pages, id_col)
    task = F.shiftright(F.monotonically_increasing_id(), 33)
    html = text_or_empty(html_col)
    url = F.regexp_replace(F.coalesce(F.nullif(F.col(url_col).cast("string"), F.lit("")), F.lit("unknown:")), CONTROLS, "%20")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}X-Page-Id: "), F.coalesce(F.col("page").cast("bigint").cast("string"), F.lit("-")),
        F.lit(f"{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    length = (F.octet_length("http") + F.octet_length("html")).cast("string")
    one = F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), length)
    two = F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("-"), F.lit("pages.arc"), length)

    def description(version: str) -> Column:
        body = f"{version} 0 ordinate\n{ARC_FIELDS[version]}\n"
        rest = "text/plain" if version == "1" else "text/plain 200 - - 0 pages.arc"
        return F.lit(f"filedesc://pages.arc 0.0.0.0 {date} {rest} {len(body)}\n{body}\n")

    rows = pages.select(F.col(id_col).alias("page"), url.alias("url"), html.alias("html"))
    even = task % 2 == 0
    for row in rows.groupBy(classes(F.octet_length("html")).alias("class")).count().collect():
        class_, most = row["class"], records_of_file(row["class"])
        record = F.concat(F.when(first_of_file(most), F.when(even, description("1")).otherwise(description("2"))).otherwise(F.lit("")), F.when(even, one).otherwise(two), F.lit("\n"), F.col("http"), F.col("html"))
        some = rows.where(classes(F.octet_length("html")) == class_).withColumn("http", http)
        some.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", most).option("compression", "gzip").text(f"{path}/{class_}")


# Reading ARC.

def arc_records(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(fields, content, offset) of each record of an ARC file: the version block names the fields, the last of which is the length."""
    fields: list[str] = []
    while True:
        offset = file.tell()
        if not (line := file.readline()):
            return
        line = line.rstrip(b"\r\n")
        if not line:
            continue  # between records
        values = line.decode("latin-1").split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"ARC header without a length: {line[:200]!r}")
        content = file.read(int(values[-1]))
        if len(content) != int(values[-1]):
            raise ValueError(f"ARC record of {values[0]} ends early")
        if values[0].startswith("filedesc://"):
            lines = content.decode("latin-1").splitlines()
            fields = lines[1].split(" ") if len(lines) > 1 else []
            if lines[:1] and lines[0].split(" ")[0] not in ARC_FIELDS or fields[:1] != ["URL"] or fields[-1] != "Archive-length":
                raise ValueError(f"unknown ARC version: {lines[:2]}")
            continue
        if not fields or len(values) < len(fields):
            raise ValueError(f"ARC header without its fields: {line[:200]!r}")
        # A url of older writers may hold spaces: the other fields are counted from the end.
        extra = len(values) - len(fields)
        values = [" ".join(values[:extra + 1]), *values[extra + 1:]]
        yield dict(zip(fields, values)), content, offset


def split_http(content: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Header block with its blank line, body, header fields. Content without an HTTP status line is all body."""
    end = content.find(b"\r\n\r\n") if content.startswith(b"HTTP/") else -1
    if end < 0:
        return b"", content, {}
    lines = content[:end].decode("latin-1").split(CRLF)[1:]
    return content[:end + 4], content[end + 4:], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("-?[0-9]+", text) else None


def batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the archives in a folder, gzipped or plain; each is one value of less than 2 GB."""
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,arc,warc}").option("recursiveFileLookup", "true").load(path).select("path", "content")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, io.BufferedIOBase]]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            raw = pa.BufferReader(content.as_buffer())
            zipped = content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b"
            yield path.as_py(), io.BufferedReader(gzip.GzipFile(fileobj=raw)) if zipped else io.BytesIO(raw.read())


ARC_ROW = {
    "record_id": pa.string(), "kind": pa.string(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "same": pa.binary(), "stamp": pa.string(), "digest": pa.string(),
    "url": pa.string(), "ip": pa.string(), "content_type": pa.string(), "result_code": pa.string(), "http": pa.binary(), "payload": pa.binary(),
}
SPARK_TYPES = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Per ARC record: ARC_ROW's columns; without payloads only those as far as stamp.

    kind is response for content with an HTTP status line, resource for all else (such as dns: records). page_id is that of
    write_arc(), null in other archives. same is the payload's SHA-256, digest its SHA-1 in base32; result_code comes with
    version 2 only.
    """
    columns = dict(list(ARC_ROW.items())[:None if payloads else 6])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for name, file in opened(batches):
            for fields, content, offset in arc_records(file):
                http, payload, headers = split_http(content)
                url, date = fields["URL"], fields["Archive-date"]
                row = (record_id(name, offset, url, date), "response" if http else "resource", whole(headers.get("x-page-id")), len(payload), hashlib.sha256(payload).digest(), timestamp(date))
                if payloads:
                    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    row += (sha1, url, fields.get("IP-address", ""), fields.get("Content-type", ""), fields.get("Result-code"), http, payload)
                yield row

    schema = ", ".join(f"{n} {SPARK_TYPES[t]}" for n, t in columns.items())
    return files(spark, path).mapInArrow(lambda b: batched(rows(b), list(columns), list(columns.values()), lambda r: r[3] * payloads), schema)


# The converter.

def convert(spark: SparkSession, arc: str, warc: str, least: int = LEAST_REVISIT) -> None:
    """ARC files to WARC files, in a folder a class of size.

    Of responses with equal payloads (by SHA-256) of `least` bytes or more, the record of the largest page is the response,
    or the earliest record if none has a page; the others revisit it. Records without HTTP are resources of the type that
    the ARC gives. Extension fields carry the page and the payload's length.
    """
    seen = stored(read_arc(spark, arc, payloads=False), "arc-records")
    equal = seen.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least)).groupBy("same").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "record_id")).alias("largest"), F.min(F.struct("stamp", "record_id")).alias("earliest")).where("n > 1")
    top = F.col("largest.page_id")
    first = stored(equal.select("same", top.alias("top"), F.when(top.isNull(), F.col("earliest.record_id")).otherwise(F.col("largest.record_id")).alias("response")), "payloads")
    rows = read_arc(spark, arc).join(small_or_shuffled(first), "same", "left")
    revisit = (F.col("kind") == "response") & F.col("response").isNotNull() & (F.col("record_id") != F.col("response")) & ~F.coalesce(F.col("page_id") == F.col("top"), F.lit(False))
    rows = rows.withColumn("kind", F.when(revisit, F.lit("revisit")).otherwise(F.col("kind")))
    again = F.col("kind") == "revisit"
    rows = rows.withColumn("body", F.when(again, F.lit("").cast("binary")).otherwise(F.col("payload")))
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    some = lambda name, value: F.when(value.isNull(), F.lit("")).otherwise(header(name, value.cast("string")))
    clean = lambda name: F.regexp_replace(name, CONTROLS, "%20")
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        header("WARC-Type", F.col("kind")),
        header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Date", F.col("stamp")),
        header("WARC-Target-URI", clean("url")),
        some("WARC-IP-Address", F.when(F.col("ip").rlike(r"^[0-9A-Fa-f:.]+$"), F.col("ip"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(header("WARC-Refers-To", F.col("response")), some("X-Refers-To-Page-Id", F.col("top")), header("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        some("X-Page-Id", F.col("page_id")),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        header("Content-Type", F.when(F.col("kind") == "resource", F.coalesce(F.nullif(clean("content_type"), F.lit("")), F.lit("application/octet-stream"))).otherwise(F.lit("application/http;msgtype=response"))),
        header("Content-Length", (F.octet_length("http") + F.octet_length("body")).cast("string")),
        F.lit(CRLF), F.col("http").cast("string"), F.col("body").cast("string"))
    about = f"software: ordinate{CRLF}format: WARC File Format 1.1{CRLF}"
    info = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:"), F.uuid(), F.lit(f">{CRLF}WARC-Date: "), F.col("stamp"), F.lit(f"{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(about)}{CRLF * 2}{about}{CRLF * 2}"))
    for row in seen.groupBy(classes(F.col("payload_bytes")).alias("class")).count().collect():
        class_, most = row["class"], records_of_file(row["class"])
        value = F.concat(F.when(first_of_file(most), info).otherwise(F.lit("")), record).alias("value")
        rows.where(classes(F.col("payload_bytes")) == class_).select(value).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", most).option("compression", "gzip").text(f"{warc}/{class_}")
    removed(seen, first)


# Reading WARC.

def warc_records(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        fields = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = file.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("WARC record ends early")
        yield fields, block


WARC_ROW = {
    "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    "url": pa.string(), "date": pa.string(), "record_id": pa.string(), "refers_to_record": pa.string(), "content_type": pa.string(),
}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per response, revisit or resource: WARC_ROW's columns. payload_digest is the SHA-1 in hex, held against the payload where there is one.

    A revisit's payload_bytes are those of the extension field, else of its HTTP header, else null; page_id and refers_to
    are null in archives of other writers, whose record_id and refers_to_record tell records apart.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, file in opened(batches):
            for fields, block in warc_records(file):
                kind = fields["warc-type"]
                if kind not in ("response", "revisit", "resource"):
                    continue
                _, payload, headers = split_http(block) if kind != "resource" else (b"", block, {})
                stated = fields.get("warc-payload-digest", "")
                digest = base64.b32decode(stated.removeprefix("sha1:")).hex() if stated.startswith("sha1:") else None
                size = whole(fields.get("x-payload-length")) if kind == "revisit" else len(payload)
                if kind == "revisit":
                    size = whole(headers.get("content-length")) if size is None else size
                else:
                    found = hashlib.sha1(payload).hexdigest()
                    if digest is not None and found != digest:
                        raise ValueError(f"digest of {fields['warc-record-id']} differs")
                    digest = found
                yield whole(fields.get("x-page-id")), size, digest, kind, whole(fields.get("x-refers-to-page-id")), fields.get("warc-target-uri"), fields["warc-date"], fields["warc-record-id"], fields.get("warc-refers-to"), fields.get("content-type")

    schema = ", ".join(f"{n} {SPARK_TYPES[t]}" for n, t in WARC_ROW.items())
    return files(spark, path).mapInArrow(lambda b: batched(rows(b), list(WARC_ROW), list(WARC_ROW.values()), lambda r: 400), schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages written as ARC, converted to WARC in the shared folder, and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload. Rows that repeat the largest page of a payload are all responses; a null page is
    smaller than any and keeps a record of its own. Pages are whole numbers: others raise TypeError. A long page has a
    file of its own and is one value of its readers, at most 2 GB. An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    convert(spark, arc, warc)
    delete(spark, arc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
