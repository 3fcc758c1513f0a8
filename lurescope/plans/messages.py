"""Message-like rows from the pages table, for queries and their SQL alike.

The pages' hosts lie under reserved names; they are mapped to other ones by page number, so that domains differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.functions.text import host_of, path_of, query_of, registrable_domain
from lurescope.runtime import table

TAILS = ("top", "com", "co.uk", "net", "zip")
#: A catalogue of rules: severity, label, family, technique; each holds by a condition over a message.
RULES = (
    (1, "medium", "link: high-abuse domain", "link", "T1566.002"),
    (2, "low", "tracking: query parameter", "", ""),
    (3, "high", "listed host", "reputation", "T1566.002"),
    (4, "low", "body: large", "", "T1027"),
    (5, "low", "link: not encrypted", "", ""),
    (6, "medium", "link: fragment", "content", "T1027"),
    (7, "high", "body: not closed", "content", "T1027.006"),
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, url, host, base, path, query, subject, html_chars, closed."""
    pages = table(spark, sf_dir, "pages")
    tails = F.element_at(F.array(*map(F.lit, TAILS)), (F.col("page_id") % 5 + 1).cast("int"))
    stem = F.regexp_replace(host_of(F.col("url")), r"\.example\.(com|net|org)$", "")
    rows = pages.select(F.col("page_id").alias("msg_id"), "url", F.concat(stem, F.lit("."), tails).alias("host"), path_of(F.col("url")).alias("path"), query_of(F.col("url")).alias("query"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("subject"), F.length("html").cast("long").alias("html_chars"), F.contains(F.col("html"), F.lit("</body>")).alias("closed"))
    return rows.withColumn("base", registrable_domain(F.col("host")))


def signals(rows: DataFrame) -> DataFrame:
    """msg_id, ord, severity, label, family, techniques: one pass over the messages, no join."""
    tests = (
        F.col("base").rlike(r"\.(top|zip)$"),
        F.col("query") != "",
        F.col("host").rlike("spam|pills"),
        F.col("html_chars") > 8000,
        F.col("url").startswith("http://"),
        F.contains(F.col("url"), F.lit("#")),
        ~F.col("closed"),
    )
    found = [F.when(test, F.struct(F.lit(n).alias("ord"), F.lit(s).alias("severity"), F.lit(label).alias("label"), F.lit(f).alias("family"), F.lit(t).alias("technique"))) for test, (n, s, label, f, t) in zip(tests, RULES)]
    each = rows.select("msg_id", F.explode(F.array_compact(F.array(*found))).alias("s")).select("msg_id", "s.*")
    return each.withColumn("techniques", F.when(F.col("technique") != "", F.array("technique")).otherwise(F.array().cast("array<string>")))


def traits(rows: DataFrame) -> DataFrame:
    """msg_id, kind, value."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("link", F.concat("host", "path")), ("subject", F.substring("subject", 1, 3)), ("display name", F.concat(F.lit("n"), (F.col("html_chars") % 40).cast("string"))))])
    return rows.select("msg_id", F.explode(kinds).alias("t")).select("msg_id", "t.*").where("value <> ''")


SQL_MESSAGES = """
m0 AS (SELECT page_id AS msg_id, url, html, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS raw_host FROM pages),
m1 AS (SELECT *, regexp_replace(raw_host, '\\.example\\.(com|net|org)$', '') || '.' || (['top', 'com', 'co.uk', 'net', 'zip'])[msg_id % 5 + 1] AS host FROM m0),
m AS (SELECT msg_id, url, host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query,
        regexp_extract(html, '<title>([^<]*)</title>', 1) AS subject, length(html) AS html_chars, contains(html, '</body>') AS closed,
        CASE WHEN len(string_split(host, '.')) < 3 THEN host WHEN host LIKE '%.co.uk' THEN array_to_string((string_split(host, '.'))[-3:], '.') ELSE array_to_string((string_split(host, '.'))[-2:], '.') END AS base
      FROM m1)"""
SQL_SIGNALS = SQL_MESSAGES + """,
s AS (SELECT msg_id, 1 AS ord, 'medium' AS severity, 'link: high-abuse domain' AS label, 'link' AS family, 'T1566.002' AS technique FROM m WHERE base LIKE '%.top' OR base LIKE '%.zip'
  UNION ALL SELECT msg_id, 2, 'low', 'tracking: query parameter', '', '' FROM m WHERE query <> ''
  UNION ALL SELECT msg_id, 3, 'high', 'listed host', 'reputation', 'T1566.002' FROM m WHERE host LIKE '%spam%' OR host LIKE '%pills%'
  UNION ALL SELECT msg_id, 4, 'low', 'body: large', '', 'T1027' FROM m WHERE html_chars > 8000
  UNION ALL SELECT msg_id, 5, 'low', 'link: not encrypted', '', '' FROM m WHERE url LIKE 'http://%'
  UNION ALL SELECT msg_id, 6, 'medium', 'link: fragment', 'content', 'T1027' FROM m WHERE contains(url, '#')
  UNION ALL SELECT msg_id, 7, 'high', 'body: not closed', 'content', 'T1027.006' FROM m WHERE NOT closed)"""
SQL_TRAITS = SQL_MESSAGES + """,
t AS (SELECT DISTINCT * FROM (SELECT msg_id, 'link' AS kind, host || path AS value FROM m UNION ALL SELECT msg_id, 'subject', substring(subject, 1, 3) FROM m
  UNION ALL SELECT msg_id, 'display name', 'n' || CAST(html_chars % 40 AS VARCHAR) FROM m) WHERE value <> '')"""
