"""Content-addressed web archive: payloads stored once by SHA-256, exact record headers kept apart.

`write_archive` writes two tables below a folder: `payloads` (digest, payload), one row per distinct
payload, and `headers` (digest, header), the exact WARC/1.1 header bytes of every record.
`reconstruct` joins them to the original records and verifies every payload against its digest.

Of the records with equal payloads of at least `min_bytes` bytes, that with the largest id is the
response and the others are revisits of it; smaller payloads are responses all.  A null payload is an
empty one, a null id orders first and is left out of the record, a null address is empty.  Repeated
rows are records of their own.  Other columns of the input are ignored.  A payload that a third of
the records share is reduced before every shuffle and its join is split by the skew-join rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellsight.llm.common import ROW, materialise, text_bytes, with_row

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(hex_digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal digest of 40 digits: five digits give four characters."""
    out = []
    for k in range(0, 40, 5):
        value = F.conv(F.substring(hex_digest, k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*out)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_name(id_col: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    payload = text_bytes(payload_col)
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = materialise(
        with_row(
            pages.select(
                F.col(f"`{id_col}`").cast("long").alias("id"),
                url.alias("url"),
                F.sha2(payload, 256).alias("digest"),
                base32_of_hex(F.sha1(payload)).alias("sha1"),
                F.octet_length(payload).cast("long").alias("size"),
            )
        ),
        "records",
    )
    newest = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max(F.struct("id", ROW)).alias("newest"))
    typed = rows.join(newest, "digest", "left")
    revisit = F.coalesce(F.col("newest")[ROW] != F.col(ROW), F.lit(False))
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_name(F.col("id"))),
        _line("WARC-Date", F.lit(WARC_DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_name(F.col("newest")["id"])), _line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    typed.select("digest", text.cast("binary").alias("header")).write.parquet(f"{path}/headers")
    stored = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).dropDuplicates(["digest"])
    stored.write.parquet(f"{path}/payloads")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: its header, the full payload, the record's bytes and whether the digest holds."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    joined = headers.join(payloads, "digest")
    block = F.when(_field("WARC-Type") == "revisit", F.lit(bytearray()).cast("binary")).otherwise(F.col("payload"))
    return joined.select(
        "header",
        "payload",
        F.concat("header", block, F.lit(bytearray(b"\r\n\r\n")).cast("binary")).alias("record"),
        (F.sha2("payload", 256) == F.col("digest")).alias("verified"),
    )


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)


def describe(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The fields of reconstructed records; a payload that fails its digest is an error."""
    named = lambda field: F.regexp_extract(_field(field), "<urn:page:(-?[0-9]+)>", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    digest = base32_of_hex(F.sha1("payload"))
    sound = F.col("verified") & (F.concat(F.lit("sha1:"), digest) == _field("WARC-Payload-Digest"))
    return records.select(
        number(named("WARC-Record-ID")).alias(id_col),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(sound, digest).otherwise(F.raise_error(F.lit("a payload does not match its digest"))).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        number(named("WARC-Refers-To")).alias("refers_to"),
    )
