"""WARC archives: a writer with payload de-duplication, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize, scratch_path

#: Ends a record's header, and again its block.
MARK = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Records of an archive file, and bytes of one: a file is read by one task, and none reaches the 2 GB that Spark's
#: binary source refuses. Pages of up to FILE_BYTES / RECORDS_PER_FILE bytes are written by number alone.
RECORDS_PER_FILE = 4096
FILE_BYTES = 256 << 20
#: What a salvage reader looks for after damage: a version line or a gzip member.
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
GZIP_MAGIC = b"\x1f\x8b\x08"

RECORD = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("problem", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 without padding: 40 hex digits in eights of 20 bits, as base-32 digits."""
    hexed = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _mark_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Adds record_type and refers_to. Of equal payloads of at least least_bytes, the page with the
    largest id is the response and the others revisit it; rows that repeat its id are responses too.
    """
    sized = pages.where(F.col("bytes") >= least_bytes)
    shared = sized.groupBy("digest", "bytes").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first")
    # Written, so that the join below is of two shuffles and a payload that a third of the pages hold can be split.
    shared, _ = materialize(shared, "warc-shared")
    joined = pages.join(shared, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left").drop("d", "b")
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    return joined.select("*", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, compression: str = "none", file_bytes: int = FILE_BYTES) -> None:
    """Write one WARC record per row below path: a response with the payload, or a revisit.

    Records are text of known length, so Spark's own text sink writes them: up to `records_per_file`
    records or about file_bytes bytes a file (a larger record has one of its own), committed task by task on any store, each ended by the two line breaks that the
    format asks for. A null payload is empty, a null URL has no WARC-Target-URI, a null id is `null`.
    With compression gzip every record is a member. Line breaks within a URL become spaces. An empty table writes no record. Only the three named
    columns are read.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.regexp_replace(F.col(url_col), r"[\r\n]", " ").alias("url"), text.alias("payload"))
    rows = rows.select("*", base32_sha1(F.encode("payload", "UTF-8")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    rows = _mark_revisits(rows, least_bytes)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    body = F.concat(F.lit(HTTP_HEAD), F.when(F.col("kind") == "response", F.col("payload")).otherwise(""))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("kind")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.col("url"))),
        F.when(F.col("kind") == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    records = rows.select(F.concat(lines, F.lit(MARK), body).alias("value"), "bytes")
    small = file_bytes // records_per_file
    most = pages.agg(F.max(F.octet_length(payload_col))).first()[0] or 0
    parts = [(records.where(F.col("bytes") <= small), records_per_file)] if most > small else [(records, records_per_file)]
    # Larger pages by powers of 16 of their size: at most eight writes more, and only those that have rows.
    low = small
    while low < most:
        high = 16 * low
        part = (F.col("bytes") > low) & (F.col("bytes") <= high)
        if most <= high or not pages.where((F.octet_length(payload_col) > low) & (F.octet_length(payload_col) <= high)).isEmpty():
            parts.append((records.where(part), max(1, file_bytes // high)))
        low = high
    for part, number in parts:
        if compression == "gzip":
            _write_members(part.select("value"), path, number)
        else:
            part.select("value").write.mode("append").option("lineSep", MARK).option("maxRecordsPerFile", number).option("compression", compression).text(path)


def _write_members(records: DataFrame, path: str, records_per_file: int) -> None:
    """Write records as gzip members of their own, so that damage to one costs no other.

    The text sink puts a byte behind every row; it is the last byte of the member, which is 0 (the top byte
    of its length). Where a record is too long for that an empty member follows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                member = gzip.compress((text.as_py() + MARK).encode("utf-8", "surrogatepass"), mtime=0)
                out.append((member if member[-1] == 0 else member + gzip.compress(b"", mtime=0))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = records.mapInArrow(work, "value binary").select(F.col("value").cast("string"))
    members.write.mode("append").option("lineSep", "\x00").option("maxRecordsPerFile", records_per_file).text(path)


#: A block's length; other digits, or more than any file has, are damage.
LENGTH = re.compile("[0-9]{1,18}")


def _head(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The header fields (names in lower case) of the record at that place, and where its block begins."""
    line = VERSION.match(data, at)
    end = data.find(b"\r\n\r\n", at)
    if not line or end < 0:
        return None
    fields = {}
    for raw in data[line.end() : end].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields, end + 4


def _checked(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at that place, the offset behind it, and what is wrong with it ("" if nothing)."""
    found = _head(data, at)
    if found is None:
        return None, at, "no record header"
    fields, begin = found
    if not LENGTH.fullmatch(fields.get("content-length", "")):
        return None, at, "no content length"
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "block does not end where its length says"
    block = data[begin:end]
    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        return None, at, "payload digest differs"
    return {
        "record_type": kind,
        "record_id": fields.get("warc-record-id"),
        "refers_to_id": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": digest or None,
        "payload": None if kind == "revisit" else payload,
    }, end + 4, ""


def salvage(data: bytes) -> Iterator[dict]:
    """The records of one archive's bytes, and its quarantined gaps as rows with a `problem`.

    After a failed check the reader searches for the next version line whose record passes every
    check; the bytes between are one gap. A gap is logged with its byte range and the first failure.
    """
    at, size = 0, len(data)
    while at < size:
        record, end, problem = _checked(data, at)
        if record:
            yield {"start": at, "end": end, "problem": None} | record
            at = end
            continue
        begin, at = at, size
        look = begin + 1
        while m := VERSION.search(data, look):
            record, _, _ = _checked(data, m.start())
            if record:
                at = m.start()
                break
            look = m.start() + 1
        yield {"start": begin, "end": at, "problem": problem}


def _prefix(data: bytes, at: int, end: int, step: int = 1 << 10) -> bytes:
    """What the damaged gzip member at that place inflates to before it fails."""
    engine, parts = zlib.decompressobj(31), []
    try:
        for k in range(at, end, step):
            # Byte by byte where a step fails, so that what comes before the damage is kept.
            before = engine.copy()
            try:
                parts.append(engine.decompress(data[k : min(k + step, end)]))
            except zlib.error:
                for i in range(k, min(k + step, end)):
                    parts.append(before.decompress(data[i : i + 1]))
            if engine.eof:
                break
    except zlib.error:
        pass
    return b"".join(parts)


def _member(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The plain bytes of the gzip member at that place and the offset behind it; zlib.error if it is damaged."""
    engine, parts = zlib.decompressobj(31), []
    while at < len(data) and not engine.eof:
        parts.append(engine.decompress(data[at : at + step]))
        at = min(at + step, len(data))
    if not engine.eof:
        raise zlib.error("member ends early")
    return b"".join(parts), at - len(engine.unused_data)


def unzip(data: bytes) -> Iterator[tuple[int, int, bytes, str]]:
    """The gzip members of data: (start, end, plain bytes, problem). Members that fail are gaps that
    reach to the next member that inflates and passes its checksum.
    """
    at, size = 0, len(data)
    while at < size:
        begin, problem, found = at, "", None
        while at < size and found is None:
            try:
                found = _member(data, at)
            except zlib.error as e:
                problem = problem or f"gzip: {e}"
                following = data.find(GZIP_MAGIC, at + 1)
                at = following if following >= 0 else size
        if at > begin:
            yield begin, at, b"", problem
        if found is not None:
            yield at, found[1], found[0], ""
            at = found[1]


def salvage_zipped(data: bytes, offset: int = 0) -> Iterator[dict]:
    """The records of gzip members, with their member's byte range; and gaps. Of a damaged member the records
    that it inflates to before the damage are kept, and its range is a gap as well."""
    for start, end, plain, problem in unzip(data):
        if problem:
            at = start if data.startswith(GZIP_MAGIC, start) else data.find(GZIP_MAGIC, start, end)
            while 0 <= at < end:
                following = data.find(GZIP_MAGIC, at + 1, end)
                for r in salvage(_prefix(data, at, end)):
                    if not r["problem"]:
                        yield r | {"start": offset + start, "end": offset + end}
                at = following
            yield {"start": offset + start, "end": offset + end, "problem": problem}
        else:
            for r in salvage(plain):
                yield r | {"start": offset + start, "end": offset + end}


def salvage_plain(data: bytes) -> Iterator[dict]:
    """As salvage; a gap that holds gzip members is read as these."""
    for r in salvage(data):
        gap = data[r["start"] : r["end"]] if r["problem"] else b""
        if GZIP_MAGIC in gap:
            found = list(salvage_zipped(gap, r["start"]))
            if any(not x["problem"] for x in found):
                yield from found
                continue
        yield r


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.name, {"long": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString().replace("bigint", "long"), pa.string())) for f in RECORD])
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = content.as_py() or b""
            rows = salvage_zipped(data) if data.startswith(GZIP_MAGIC) or file.endswith(".gz") else salvage_plain(data)
            held: list[dict] = []
            for r in rows:
                held.append(r | {"file": file})
                if len(held) == 512:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record and every quarantined gap of the archives below path.

    Columns are those of RECORD; `problem` is null for records and tells what failed for gaps,
    `start` and `end` are byte offsets in the file (of the gzip member, if compressed). A revisit has no
    payload; `refers_to_id` names the record that has it. Files without a record give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, RECORD)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages as archives in the shared folder, read them back, and report what was found.

    One row per record: id, payload_bytes, payload_digest, record_type, refers_to, target_uri. A revisit's
    length is that of the response it refers to. Nulls and repeated rows are as in write_archives.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    found = read_archives(spark, path).where(F.col("problem").isNull()).select(number(F.col("record_id")).alias(id_col), F.octet_length("payload").cast("long").alias("bytes"), "payload_digest", "record_type", number(F.col("refers_to_id")).alias("refers_to"), "target_uri")
    # Payloads are not needed again; what was read is written once for the two uses below.
    found, _ = materialize(found, "warc-found")
    lengths = found.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d")).agg(F.max("bytes").alias("of"))
    wanted, _ = materialize(lengths.join(found.where("record_type = 'revisit'").select(F.col("payload_digest").alias("d")).distinct(), "d", "left_semi"), "warc-lengths")
    joined = found.join(wanted, F.col("payload_digest") == F.col("d"), "left")
    return joined.select(id_col, F.coalesce("bytes", "of").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "target_uri")
