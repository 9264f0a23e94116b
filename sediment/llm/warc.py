"""WARC archives: write pages as records, read records, and put the records of a capture together.

Method: transaction assembly.  A capture is a response or revisit record; request and metadata records name it in
WARC-Concurrent-To.  They are joined through these ids, and one nested row per capture comes out.  A payload
that several pages have is written once, as a response; the others are revisit records that refer to it.

Archives are read as text between the version lines that open records, so an uncompressed file is split like any other.  A
compressed one is one gzip stream and one task; so files are written with RECORDS records at most, and there are many.  A
record is complete if its length is what its header says; only files in which one is not (a payload holds such
a line) are put together again, by length, from the first record on.

* A null payload is empty.  A null URL leaves its header out, a null id the id's line.  A row that is repeated is a record that is repeated.
* Of pages with one payload and one id, those with the smallest URL are responses.
* A capture without request or metadata has nulls there; of several, the one with the smallest id is taken and all are counted.
* Records that break off, and what isn't a record, are left out; `broken_records` has them.  No record: no row.
* Line breaks inside a URL are written as %0D and %0A.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.staging import stage
from sediment.types import col

#: What opens a record, what ends one, the alphabet of base 32 and the revisit profile of the standard.
OPENS, ENDS = "WARC/1.", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = ("response", "revisit")

#: Records of an archive at most: some ten to hundred megabytes of web pages.
RECORDS = 10_000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32; ten hexadecimal digits are eight of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS32, BASE32)


def record_id(*parts: Column) -> Column:
    """A record's id, made of what the record is about, so that a task that runs again writes the same."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    pieces = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record as bytes, without the two line breaks that end it."""
    lines = [F.lit(f"{OPENS}1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # null if the value is
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines).cast("binary"), F.lit(ENDS).cast("binary"), block)


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip",
                  key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write a request, a response or revisit, and a metadata record for each page.

    A payload of at least `min_bytes` that another page has too is in the response of the smallest id alone.
    """
    body = F.coalesce(col(payload).cast("binary"), F.lit(b""))
    clean = F.replace(F.replace(col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(col(key).alias("page"), clean.alias("url"), body.alias("body"), base32_sha1(body).alias("digest"))
    which = F.struct(F.coalesce(F.col("page").cast("long"), F.lit(-(2**63))).alias("page"), F.coalesce("url", F.lit("")).alias("url"))
    shared = stage(
        rows.where(F.octet_length("body") >= min_bytes).groupBy("digest")
        .agg(F.min(which).alias("first"), F.max(which).alias("last")).where("first <> last").select("digest", "first")
    )
    joined = rows.join(shared, "digest", "left")
    again = (F.octet_length("body") >= min_bytes) & F.col("first").isNotNull() & (F.col("first") != which)

    first_page = F.nullif(F.col("first.page"), F.lit(-(2**63)))
    own = record_id(F.lit("capture"), F.col("page"), F.col("url"), F.col("digest"))
    other = record_id(F.lit("capture"), first_page, F.col("first.url"), F.col("digest"))
    about = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(ENDS)
    ).cast("binary")
    answer = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", [("WARC-Record-ID", own), *about, digest, answer], F.concat(http, F.col("body")))
    revisit = _record(
        "revisit", [("WARC-Record-ID", own), *about, digest, ("WARC-Profile", F.lit(SAME_PAYLOAD)), ("WARC-Refers-To", other), answer], http
    )
    request = _record(
        "request",
        [("WARC-Record-ID", record_id(F.lit("request"), own)), *about, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + ENDS)).cast("binary"),
    )
    fields = F.coalesce(F.concat(F.lit("page_id: "), F.col("page").cast("string"), F.lit("\r\n")), F.lit("")).cast("binary")
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", record_id(F.lit("metadata"), own)), *about, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        fields,
    )
    records = joined.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("record"))
    writer = records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", ENDS)
    writer.option("compression", compression).option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS).text(folder)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """What stands between the version lines of the files: `file`, `place` (rising in each file), `value` (bytes),
    `head` (bytes of its header) and `size` (what it takes to be complete)."""
    read = spark.read.option("lineSep", OPENS).text(folder)
    pieces = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"),
        F.col("value").cast("binary").alias("value"),
    )
    return _measured(pieces)


def _up_to(text: Column, mark: str) -> Column:
    """What stands before the first `mark`; null without one.  Places in texts count characters, so a place in the
    bytes is the length of what stands before it."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1))


def _measured(pieces: DataFrame) -> DataFrame:
    length = F.regexp_extract("header", r"(?im)^Content-Length:[ \t]*(\d+)[ \t]*\r?$", 1)
    return (
        pieces.withColumn("header", _up_to(F.col("value").cast("string"), ENDS))
        .withColumn("head", F.octet_length("header"))
        .withColumn("length", F.nullif(length, F.lit("")).try_cast("long"))
        .withColumn("size", F.col("head") + 8 + F.col("length"))
    )


def _complete() -> Column:
    return F.octet_length("value") == F.col("size")


def _numbered(group: pd.DataFrame) -> pd.DataFrame:
    """Which record each piece of a file belongs to: pieces are taken until a record has its size."""
    group = group.sort_values(["block", "row"], ignore_index=True)
    record, at = [], 0
    sizes, wanted = group["bytes"].tolist(), group["size"].tolist()
    while at < len(group):
        end, got = at + 1, sizes[at]
        if wanted[at] == wanted[at]:  # not missing
            while got < wanted[at] and end < len(group):
                got += len(OPENS) + sizes[end]
                end += 1
            if got != wanted[at]:
                end = at + 1  # not a record
        record += [at] * (end - at)
        at = end
    return group.assign(record=record)[["file", "block", "row", "record"]]


def _put_together(pieces: DataFrame) -> DataFrame:
    """The records of files in which a payload holds what opens a record."""
    lengths = pieces.select("file", "place.*", F.octet_length("value").alias("bytes"), F.col("size").cast("double").alias("size"))
    numbers = lengths.groupBy("file").applyInPandas(_numbered, "file string, block long, row long, record long")
    numbers = numbers.select("file", F.struct("block", "row").alias("place"), "record")
    whole = (
        pieces.select("file", "place", "value").join(numbers, ["file", "place"]).groupBy("file", "record")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("parts"))
    )
    joined = F.array_join(F.transform("parts", lambda p: p["value"].cast("string")), OPENS).cast("binary")
    return _measured(whole.select("file", F.lit(None).cast("struct<block:bigint,row:bigint>").alias("place"), joined.alias("value")))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    pieces = _pieces(spark, folder)
    torn = stage(pieces.where((F.octet_length("value") > 0) & ~F.coalesce(_complete(), F.lit(False))).select("file").distinct())
    if torn.isEmpty():
        return pieces
    return pieces.join(torn, "file", "left_anti").unionByName(_put_together(pieces.join(torn, "file", "left_semi")))


def broken_records(spark: SparkSession, folder: str) -> DataFrame:
    """`file` and `value` of what is not a complete record."""
    return _records(spark, folder).where((F.octet_length("value") > 0) & ~F.coalesce(_complete(), F.lit(False))).select("file", "value")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: `type`, `id`, `concurrent_to` (a list), `refers_to`, `uri`, `date`, `content_type`, `payload`,
    `payload_bytes` and `payload_digest`.  The payload of an HTTP message is what follows its header."""
    def header(name):
        return F.nullif(F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))

    found = _records(spark, folder).where(_complete())
    block = F.substring(F.col("value"), F.col("head") + 5, F.col("length").cast("int"))
    parsed = found.select(
        F.lower(header("WARC-Type")).alias("type"),
        header("WARC-Record-ID").alias("id"),
        F.regexp_extract_all("header", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*([^\r\n]*)"), 1).alias("concurrent_to"),
        header("WARC-Refers-To").alias("refers_to"),
        header("WARC-Target-URI").alias("uri"),
        header("WARC-Date").alias("date"),
        header("Content-Type").alias("content_type"),
        block.alias("block"),
    )
    head = F.octet_length(_up_to(F.col("block").cast("string"), ENDS))
    message = F.lower("content_type").startswith("application/http") & head.isNotNull()
    payload = F.when(message, F.substring(F.col("block"), head + 5, F.octet_length("block"))).otherwise(F.col("block"))
    return parsed.withColumn("payload", payload).drop("block").withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", base32_sha1(F.col("payload"))
    )


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: `id`, `capture`, `request`, `n_requests`, `metadata`, `n_metadata`; the
    structs have the other columns of `records`, whichever they are."""
    whole = F.struct(*[c for c in records.columns if c not in ("id", "concurrent_to")])

    def concurrent(kind, count):
        named = records.where(F.col("type") == kind).select(F.explode("concurrent_to").alias("id"), F.col("id").alias("own"), whole.alias("whole"))
        return named.groupBy("id").agg(F.min_by("whole", "own").alias(kind), F.count(F.lit(1)).alias(count))

    found = records.where(F.col("type").isin(*CAPTURES)).select("id", whole.alias("capture"))
    return (
        found.join(concurrent("request", "n_requests"), "id", "left").join(concurrent("metadata", "n_metadata"), "id", "left")
        .fillna(0, ["n_requests", "n_metadata"])
    )


def resolved(assembled: DataFrame) -> DataFrame:
    """`assembled` with `original`, the capture that a revisit refers to, and `original_metadata`; null elsewhere."""
    responses = assembled.where(F.col("capture.type") == "response").groupBy("id").agg(
        F.first("capture").alias("original"), F.first("metadata").alias("original_metadata")
    )
    responses = stage(responses.withColumnRenamed("id", "original_id"))
    return assembled.join(responses, F.col("capture.refers_to") == F.col("original_id"), "left").drop("original_id")
