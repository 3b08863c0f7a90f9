"""Content-addressed WARC archive.

An archive is a folder of two Parquet tables. ``payloads`` holds the bytes of
each distinct payload once, under its SHA-256. ``records`` holds the exact
header bytes of every record and the digest of its payload. Records are
reconstructed by joining the two.

Defined results: a missing body is an empty payload. A missing URL gives a
record without a target line, a missing id an empty id. Rows that repeat
(same id, URL and body) are separate records; one of them may be the response,
the others revisit it. Among equal payloads the smallest id is the response, a
missing id is the largest, ties go by URL. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EOL = "\r\n"
# WARC 1.1 field names and the profile of a revisit.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:haulframe:page:"
# Digits of base 32, as numbers are printed and as RFC 4648 writes them.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column, n_hex: int = 40) -> Column:
    """Base32 of a hex string whose length is a multiple of ten digits (40 bits)."""
    parts = [
        F.lpad(F.conv(F.substring(hex_digest, at, 10), 16, 32), 8, "0") for at in range(1, n_hex, 10)
    ]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


#: Characters that end a line or cannot stand in a header: controls, and the separators of Unicode.
_UNSAFE = [*map(chr, range(32)), "\x7f", "\x85", "\u2028", "\u2029"]


def _uri(c: Column) -> Column:
    """Characters that would end or blur a header line are percent-encoded."""
    escaped = c
    for x in _UNSAFE:
        escaped = F.replace(escaped, F.lit(x), F.lit("".join(f"%{b:02X}" for b in x.encode())))
    return F.when(c.rlike("[\\x00-\\x1F\\x7F\\x85\\u2028\\u2029]"), escaped).otherwise(c)


def _record_id(page_id: Column, copy: Column) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(_uri(page_id.cast("string")), F.lit("")), F.lit(":"), copy.cast("string"), F.lit(">"))


def write_archive(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", body: str = "html",
    min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one record per row of ``pages`` to the archive at ``path``.

    Payloads of at least ``min_bytes`` bytes are written as a response once and
    as revisits after that; smaller ones are always responses. Equal digests
    with different bytes fail the job. ``pages`` is read twice.
    """
    rows = pages.select(
        F.col(page_id).alias("id"), F.col(url).alias("url"),
        F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))

    # map-side combined: a payload crosses the shuffle once per task at most
    check = F.xxhash64("payload")
    payloads = rows.groupBy("digest").agg(
        F.any_value("payload").alias("payload"),
        F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "url")).alias("first"),
        (F.min(check) == F.max(check)).alias("same"),
        (F.min(F.octet_length("payload")) == F.max(F.octet_length("payload"))).alias("same_length"),
    )
    payloads.select(
        F.when(F.col("same") & F.col("same_length"), F.col("digest"))
        .otherwise(F.raise_error(F.concat(F.lit("payloads differ under one digest: "), "digest"))).alias("digest"),
        "payload", F.octet_length("payload").cast("long").alias("length"),
        base32(F.sha1("payload")).alias("sha1"), "first",
    ).write.parquet(f"{path}/payloads")

    spark = pages.sparkSession
    known = spark.read.parquet(f"{path}/payloads").select("digest", "length", "sha1", "first")
    # repeated rows travel as one row with a count
    repeated = rows.groupBy("id", "url", "digest").agg(F.count(F.lit(1)).alias("copies"))
    records = repeated.join(known, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    is_first = F.col("first.id").eqNullSafe(F.col("id")) & F.col("first.url").eqNullSafe(F.col("url")) & (F.col("copy") == 1)
    response = is_first | (F.col("length") < min_bytes)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + EOL + "Content-Type: text/html; charset=utf-8" + EOL + "Content-Length: "),
        F.col("length").cast("string"), F.lit(EOL + EOL),
    )
    block = F.octet_length("http") + F.when(F.col("response"), F.col("length")).otherwise(0)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)  # noqa: E731  missing value, missing line
    header = F.concat(F.concat_ws(
        EOL, F.lit("WARC/1.1"),
        field("WARC-Type", F.when(F.col("response"), F.lit("response")).otherwise(F.lit("revisit"))),
        field("WARC-Record-ID", _record_id(F.col("id"), F.col("copy"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", _uri(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(~F.col("response"), field("WARC-Profile", F.lit(PROFILE))),
        F.when(~F.col("response"), field("WARC-Refers-To", _record_id(F.col("first.id"), F.lit(1)))),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", block.cast("string")),
    ), F.lit(EOL + EOL))
    records.withColumns({"response": response, "http": http}).select(
        header.alias("header"), F.col("http").alias("http_header"), "digest"
    ).write.parquet(f"{path}/records")


def header_field(name: str, header: Column | None = None) -> Column:
    """Value of a named field of a record header, NULL where the line is missing."""
    header = F.col("header") if header is None else header
    value = F.regexp_extract(header, rf"(?md)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(F.contains(header, F.lit(f"\n{name}: ")), value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records with their payloads: header, http_header, payload, payload_digest.

    Every payload is hashed again; one that does not match its address fails.
    The payload of a revisit is that of the record it refers to.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select(
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest"))).alias("digest"),
        "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
    )
    return spark.read.parquet(f"{path}/records").join(payloads, "digest")


def warc_record(df: DataFrame) -> DataFrame:
    """Adds ``record``: the bytes of the whole WARC record, as in a .warc file."""
    block = F.when(header_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return df.withColumn("record", F.concat(
        F.col("header").cast("binary"), F.col("http_header").cast("binary"), block, F.lit(EOL + EOL).cast("binary")
    ))


def _page(record_id: Column, id_type: str) -> Column:
    number = F.regexp_extract(record_id, f"{ID_PREFIX}(.*):\\d+>$", 1)
    return F.when(number != "", number).cast(id_type)


def record_report(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """What the headers of ``read_archive`` say, checked against the payloads; ids are read as ``id_type``."""
    said = F.regexp_extract(header_field("WARC-Payload-Digest"), "sha1:(.*)", 1)
    return records.select(
        _page(header_field("WARC-Record-ID"), id_type).alias("page_id"),
        "payload_bytes",
        F.when(said == F.col("payload_digest"), said)
        .otherwise(F.raise_error(F.lit("a header names another payload"))).alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        _page(header_field("WARC-Refers-To"), id_type).alias("refers_to"),
    )
