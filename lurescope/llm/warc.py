"""A content-addressed WARC archive.

``write_archive`` stores each payload once, under its SHA-256, in a payload table, and the exact header block of every
record, with the digest it refers to, in a header table; both are Parquet in the shared folder. ``read_archive`` joins
them and gives back the bytes of each record, ``parse_records`` reads such bytes. All of it is DataFrame operations.

A record is its header block, an empty line, its block and two empty lines, as WARC 1.1 has it. A response has the
payload as its block; a revisit has an empty block and names the record that has the payload.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.runtime import shared_dir, small, staged

#: Payloads shorter than this are never written as revisits.
REVISIT_BYTES = 100
_URN = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", path: str | None = None, least: int = REVISIT_BYTES) -> str:
    """Writes an archive of pages and returns its folder.

    The payload is the body in UTF-8, null counts as empty. Of equal payloads of at least ``least`` bytes the row with
    the smallest key is the response (the first in the stored order if that key occurs twice) and the others are
    revisits; shorter ones are all responses. A null key comes after all others. A null URL gives no target line, and
    line breaks in one are percent-encoded, so that it can't end its header line. Other columns are not read. ``pages`` is
    read twice and must give the same rows, in any order and partitions. An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    target = F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(key).cast("string").alias("id"), F.col(key).alias("ord"), target.alias("url"), payload.alias("payload"))
    rows = rows.select("id", "ord", "url", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "warc-rows")
    place = F.struct(F.col("ord").isNull().alias("last"), "ord", "row", "id")
    first = rows.groupBy("digest").agg(F.min(place).alias("first")).select("digest", F.col("first.row").alias("first_row"), F.col("first.id").alias("first_id"), F.col("first.ord").alias("first_ord"))
    marked = rows.join(first, "digest").withColumn("revisit", (F.col("row") != F.col("first_row")) & (F.col("bytes") >= least))
    uri = lambda name: F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(name), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", uri("id")),
        _line("WARC-Date", _DATE),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(_line("WARC-Profile", _PROFILE), _line("WARC-Refers-To", uri("first_id")))).otherwise(F.lit("")),
        _line("Content-Type", "text/html"),
        _line("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    )
    marked.select(F.encode(head, "UTF-8").alias("head"), "digest", "revisit").write.parquet(f"{path}/headers")
    # The payloads are read again, and rows whose key doesn't lead their digest are left out, so that no aggregation holds a
    # payload. Only where a leading key has its payload twice, one of those rows is chosen.
    numbered = pages.select(F.col(key).alias("ord"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    led = marked.select("ord", "digest", F.col("ord").eqNullSafe(F.col("first_ord")).alias("leads"))
    others = small(led.where("NOT leads").select("ord", "digest").distinct())
    same = numbered["ord"].eqNullSafe(others["ord"]) & (numbered["digest"] == others["digest"])
    stored = numbered.join(others, same, "left_anti").select("digest", "payload")
    if led.where("leads").groupBy("digest").count().where("count > 1").limit(1).count():
        stored = stored.dropDuplicates(["digest"])
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record binary, payload binary) of every record: its exact bytes, and for revisits the payload they refer to.

    A payload whose SHA-256 isn't its name, or a header whose payload is missing, raises an error when it is read.
    """
    heads = spark.read.schema("head binary, digest string, revisit boolean").parquet(f"{path}/headers")
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    checked = stored.select("digest", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("archive: wrong payload under "), F.col("digest")))).alias("payload"))
    end = F.encode(F.lit("\r\n"), "UTF-8")
    joined = heads.join(checked, "digest", "left")
    payload = F.coalesce(F.col("payload"), F.raise_error(F.concat(F.lit("archive: no payload under "), F.col("digest"))))
    block = F.when(F.col("revisit"), F.encode(F.lit(""), "UTF-8")).otherwise(payload)
    return joined.select(F.concat("head", end, block, end, end).alias("record"), payload.alias("payload"))


def parse_records(records: DataFrame) -> DataFrame:
    """record_id, record_type, target_uri, payload_digest, refers_to, content_length, block of each ``record``."""
    cut = F.expr("position(X'0D0A0D0A' IN record)")
    head = F.concat(F.decode(F.expr("substring(record, 1, cut - 1)"), "UTF-8"), F.lit("\r\n"))
    field = lambda name: F.nullif(F.regexp_extract("head", f"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    urn = lambda name: F.regexp_extract(field(name), f"^<{_URN}(.*)>$", 1)
    rows = records.withColumn("cut", cut).withColumn("head", head).withColumn("content_length", field("Content-Length").cast("int"))
    return rows.select(
        urn("WARC-Record-ID").alias("record_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        urn("WARC-Refers-To").alias("refers_to"),
        "content_length",
        F.expr("substring(record, cut + 4, content_length)").alias("block"),
        *[c for c in records.columns if c not in ("record", "content_length")],
    )


def archive_report(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, from its bytes and its payload."""
    rows = parse_records(read_archive(spark, path))
    number = lambda name: F.when(F.col(name) != "null", F.col(name)).cast(kind)
    return rows.select(number("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
