"""Triage queries over message-like rows, each with SQL of its own that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope.functions import text as T
from lurescope.operators import campaigns as C
from lurescope.operators import desk, lookups, scoring
from lurescope.plans.messages import SQL_MESSAGES, SQL_SIGNALS, SQL_TRAITS, messages, signals, traits
from lurescope.runtime import table
from lurescope.sources import sinks
from lurescope.sources.sinks import shared_indicators
from lurescope.streaming import intake

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rows(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, names)


@_query(f"""WITH {SQL_SIGNALS}, a AS (SELECT msg_id,
    sum(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END) + least(count(DISTINCT CASE WHEN severity = 'low' THEN split_part(label, ':', 1) END), 3) AS score,
    count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'high' AND family <> '') AS hf, count(DISTINCT CASE WHEN severity <> 'low' AND family <> '' THEN family END) AS n_families FROM s GROUP BY msg_id),
  b AS (SELECT m.msg_id, coalesce(score, 0) AS score, coalesce(n_high, 0) AS n_high, coalesce(hf, 0) AS hf, coalesce(n_families, 0) AS n_families FROM m LEFT JOIN a USING (msg_id))
  SELECT msg_id, CAST(score AS BIGINT) AS score, n_high, n_families, CASE WHEN n_high >= 2 OR (n_high >= 1 AND (score >= 8 OR (hf > 0 AND n_families >= 2))) OR (n_families >= 3 AND score >= 8) THEN 'LIKELY PHISHING' WHEN n_high >= 1 OR score >= 4 THEN 'SUSPICIOUS' ELSE 'NO STRONG INDICATORS' END AS verdict FROM b""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    return scoring.scored(rows, signals(rows))


@_query(f"WITH {SQL_SIGNALS} SELECT msg_id, technique, count(*) AS n_signals FROM s WHERE technique <> '' GROUP BY ALL")
def technique_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.techniques(signals(messages(spark, sf_dir)))


@_query(f"WITH {SQL_SIGNALS} SELECT severity, technique, count(*) AS n FROM s GROUP BY ROLLUP (severity, technique)")
def technique_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(messages(spark, sf_dir)).rollup("severity", "technique").agg(F.count("*").alias("n"))


@_query(f"WITH {SQL_MESSAGES} SELECT msg_id, host, base, path, query FROM m")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("msg_id", "host", "base", "path", "query")


@_query("SELECT page_id, regexp_replace(split_part(url, '://', 1), '^http', 'hxxp') || '://' || replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '[.]') || regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS defanged, url AS refanged FROM pages")
def refang_defang(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "pages").select("page_id", T.defang_url(F.col("url")).alias("defanged"))
    return out.withColumn("refanged", T.refang(F.col("defanged")))


@_query("SELECT page_id, concat_ws('.', n // 16777216, n // 65536 % 256, n // 256 % 256, n % 256) AS address FROM (SELECT page_id, 3232235777 + page_id * 65537 % 900000000 AS n FROM pages)")
def ipv4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.lit(3232235777) + F.col("page_id") * 65537 % 900000000).cast("string")
    return table(spark, sf_dir, "pages").select("page_id", T.ipv4(number).alias("address"))


def _extracted(pattern: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        return table(spark, sf_dir, "documents").select("doc_id", found.alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))

    return query


for _name, _pattern in (("email_extract", T.EMAIL), ("ip_extract", T.IPV4), ("phone_extract", T.PHONE)):
    QUERIES[_name] = _extracted(_pattern)
    ORACLE_SQL[_name] = f"SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_pattern}')) AS value FROM documents) GROUP BY ALL"


@_query(f"WITH {SQL_MESSAGES} SELECT msg_id, base FROM m WHERE host LIKE 'm.%' OR host LIKE 'blog.%'")
def host_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where(F.col("host").startswith("m.") | F.col("host").startswith("blog.")).select("msg_id", "base")


@_query(f"WITH {SQL_MESSAGES}, d(suffix) AS (VALUES ('top'), ('co.uk'), ('tionsh.net')) SELECT msg_id, host, suffix FROM m JOIN d ON host = suffix OR ends_with(host, '.' || suffix)")
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension = _rows(spark, "suffix string", [("top",), ("co.uk",), ("tionsh.net",)])
    return lookups.by_suffix(messages(spark, sf_dir).select("msg_id", "host"), dimension)


@_query(f"WITH {SQL_MESSAGES}, p AS (SELECT host, min(path) AS prefix FROM m GROUP BY host) SELECT m.msg_id, host, prefix FROM m JOIN p USING (host) WHERE starts_with(path, prefix)")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("msg_id", "host", "path")
    return lookups.by_prefix(rows, rows.groupBy("host").agg(F.min("path").alias("prefix"))).select("msg_id", "host", "prefix")


@_query(f"WITH {SQL_MESSAGES} SELECT msg_id, base FROM m WHERE split_part(base, '.', 2) NOT IN ('top', 'net')")
def dim_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("msg_id", "base", F.split_part("base", F.lit("."), F.lit(2)).alias("tld"))
    return lookups.unlisted(rows, _rows(spark, "tld string", [("top",), ("net",)]), "tld").select("msg_id", "base")


@_query(f"WITH {SQL_MESSAGES} SELECT msg_id, base FROM m WHERE split_part(base, '.', 2) IN ('top', 'net')")
def dim_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("msg_id", "base", F.split_part("base", F.lit("."), F.lit(2)).alias("tld"))
    return lookups.listed(rows, _rows(spark, "tld string", [("top",), ("net",)]), "tld").select("msg_id", "base")


_PHRASES = [("credential", "the and"), ("credential", "en la"), ("invoice", "der"), ("delivery", "license")]


@_query("SELECT doc_id, category FROM documents, (VALUES ('credential', ['the and', 'en la']), ('invoice', ['der']), ('delivery', ['license'])) AS c(category, phrases) WHERE len(list_filter(phrases, lambda p: contains(lower(text), p))) > 0")
def lure_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.containing(table(spark, sf_dir, "documents"), _PHRASES).select("doc_id", "category")


@_query(f"""WITH {SQL_MESSAGES}, l AS (SELECT DISTINCT split_part(base, '.', 1) AS label FROM m WHERE length(split_part(base, '.', 1)) >= 4), b(brand) AS (VALUES ('tionsh'), ('thther'), ('thhtre'), ('cheap'), ('ththans')),
  x AS (SELECT label, brand, length(label) = length(brand) AS same, list_filter(range(1, length(label) + 1), lambda i: substr(label, i, 1) <> substr(brand, i, 1)) AS d FROM l, b)
  SELECT label, brand, 'tld-swap' AS method FROM x WHERE label = brand UNION SELECT label, brand, 'combosquat' FROM x WHERE label <> brand AND list_contains(string_split(label, '-'), brand)
  UNION SELECT label, brand, 'typosquat' FROM x WHERE length(brand) >= 6 AND (levenshtein(label, brand) = 1 OR (same AND len(d) = 2 AND d[2] = d[1] + 1 AND substr(label, d[1], 1) = substr(brand, d[2], 1) AND substr(label, d[2], 1) = substr(brand, d[1], 1)))""")
def lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = messages(spark, sf_dir).select(F.split_part("base", F.lit("."), F.lit(1)).alias("label"))
    return lookups.lookalikes(labels, _rows(spark, "brand string", [("tionsh",), ("thther",), ("thhtre",), ("cheap",), ("ththans",)]))


@_query(f"WITH {SQL_MESSAGES}, r AS (SELECT msg_id, 'url' AS type, url AS value FROM m UNION ALL SELECT msg_id, 'domain', base FROM m) SELECT type, value, min(msg_id) AS msg_id FROM r GROUP BY ALL")
def stix_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    both = rows.select("msg_id", F.lit("url").alias("type"), F.col("url").alias("value")).unionByName(rows.select("msg_id", F.lit("domain").alias("type"), F.col("base").alias("value")))
    return shared_indicators(both)


@_query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS cell FROM documents")
def csv_safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.csv_safe(F.col("text")).alias("cell"))


@_query("SELECT page_id, CASE WHEN length(f) >= 8 THEN f ELSE '' END AS folded FROM (SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || page_id, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))) AS f FROM pages)")
def subject_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("RE: Fwd: "), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" "), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", T.subject_fold(title).alias("folded"))


@_query(f"WITH {SQL_MESSAGES}, h AS (SELECT msg_id, regexp_extract(base, '[^.]*$') AS base, host FROM m) SELECT base, count(DISTINCT msg_id) AS messages, count(DISTINCT host) AS hosts FROM h GROUP BY base HAVING count(DISTINCT host) >= 5 AND count(DISTINCT host) >= 0.6 * count(DISTINCT msg_id)")
def platform_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("msg_id", F.regexp_extract("base", r"[^.]*$", 0).alias("base"), "host")
    return C.platforms(rows)


@_query(f"WITH {SQL_TRAITS}, g AS (SELECT value, min(msg_id) AS src FROM t WHERE kind = 'link' GROUP BY value) SELECT src, msg_id AS dst, 'link' AS kind FROM t JOIN g USING (value) WHERE kind = 'link' AND msg_id <> src")
def strong_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.strong_edges(traits(messages(spark, sf_dir)))


_SQL_CAMPAIGNS = f"""WITH RECURSIVE {SQL_TRAITS},
  crowd AS (SELECT kind, value FROM t WHERE kind <> 'link' GROUP BY ALL HAVING count(*) BETWEEN 2 AND 200), w AS (SELECT t.* FROM t JOIN crowd USING (kind, value)),
  e AS (SELECT a.msg_id AS src, b.msg_id AS dst FROM t a JOIN t b USING (kind, value) WHERE kind = 'link' AND a.msg_id <> b.msg_id
    UNION SELECT a.msg_id, b.msg_id FROM w a JOIN w b USING (kind, value) WHERE a.msg_id <> b.msg_id GROUP BY ALL HAVING count(DISTINCT kind) >= 2),
  r(node, root) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.node WHERE r.root < e.dst),
  c AS (SELECT node AS msg_id, min(root) AS campaign FROM r GROUP BY node)"""


@_query(_SQL_CAMPAIGNS + " SELECT msg_id, campaign FROM c")
def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.campaigns(traits(messages(spark, sf_dir)))


@_query(_SQL_CAMPAIGNS + " SELECT campaign, count(*) AS size, 'C' || row_number() OVER (ORDER BY count(*) DESC, campaign) AS name FROM c GROUP BY campaign")
def campaign_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked(C.campaigns(traits(messages(spark, sf_dir))))


@_query(f"WITH {SQL_MESSAGES} SELECT msg_id, base, html_chars FROM m QUALIFY row_number() OVER (PARTITION BY base ORDER BY html_chars DESC, msg_id) <= 3")
def enrich_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.budgeted(messages(spark, sf_dir).select("msg_id", "base", "html_chars"), ["base"], [F.desc("html_chars"), "msg_id"], 3)


@_query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", desk.trailing_count("user_id", "ts", 3600).alias("recent"))


@_query("SELECT user_id AS workspace, CAST(ts AS DATE) AS day, count(*) AS used, greatest(5 - count(*), 0) AS room FROM events GROUP BY ALL")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.daily_room(table(spark, sf_dir, "events").select(F.col("user_id").alias("workspace"), "ts"), 5)


@_query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.latest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@_query("SELECT DISTINCT user_id, least(300 * CAST(pow(2, least(user_id % 20, 12)) AS BIGINT), 86400) AS wait FROM events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", desk.backoff(F.lit(300).cast("long"), F.col("user_id") % 20, 86400).alias("wait")).distinct()


@_query("""WITH r AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'click' GROUP BY user_id)
  SELECT event_id AS job, e.user_id AS workspace FROM events e LEFT JOIN r USING (user_id) WHERE event_type <> 'click' AND coalesce(n, 0) < 14 ORDER BY last NULLS FIRST, ts, event_id LIMIT 20""")
def fair_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("job"), F.col("user_id").alias("workspace"), "ts", "event_type")
    return desk.fair_claim(rows.where("event_type <> 'click'"), rows.where("event_type = 'click'"), 14, 20).select("job", "workspace")


_SQL_CHAIN = """WITH RECURSIVE e AS (SELECT user_id AS log, event_id AS n, event_type || CAST(event_id AS VARCHAR) AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  c(log, n, i, link) AS (SELECT log, n, i, sha256(chr(10) || body) FROM e WHERE i = 1 UNION ALL SELECT e.log, e.n, e.i, sha256(c.link || chr(10) || e.body) FROM c JOIN e ON e.log = c.log AND e.i = c.i + 1)"""


@_query(_SQL_CHAIN + " SELECT log, n, link FROM c")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("n"), F.concat("event_type", F.col("event_id").cast("string")).alias("body"))
    return desk.chain_links(rows).select("log", "n", "link")


@_query(_SQL_CHAIN + " SELECT log, count(*) AS entries, min(n) FILTER (i >= 3) AS first_broken FROM c GROUP BY log")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log with forged links from its third entry on."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("n"), F.concat("event_type", F.col("event_id").cast("string")).alias("body"))
    numbered = desk.chain_links(rows).withColumn("i", F.row_number().over(Window.partitionBy("log").orderBy("n")))
    forged = numbered.select("log", "n", F.when(F.col("i") >= 3, F.lit("forged")).otherwise(F.col("link")).alias("link"))
    return desk.verify_chain(rows.join(forged, ["log", "n"]))


@_query("SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-15' THEN CASE WHEN event_id % 4 >= 3 THEN 'failed' ELSE 'queued' END WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status FROM events")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("ts").alias("heartbeat"), (F.col("event_id") % 4).alias("attempts"))
    return desk.requeue(rows, F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "status")


@_query("SELECT c_custkey AS mailbox FROM customer WHERE c_custkey % 3 <> 0 AND (c_acctbal < 0 OR c_acctbal >= 5000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def mailboxes_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("date")
    poll = F.when(F.col("c_acctbal") >= 0, F.date_add(start, F.when(F.col("c_acctbal") >= 5000, -1).otherwise(1)))
    boxes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mailbox"), (F.col("c_custkey") % 3 != 0).alias("enabled"), poll.alias("next_poll"))
    jobs = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("mailbox"))
    return desk.mailboxes_due(boxes, jobs, start).select("mailbox")


@_query("SELECT user_id AS batch, count(*) AS total, count(*) FILTER (event_type IN ('click', 'view')) AS open, count(*) FILTER (event_type IN ('click', 'view')) = 0 AS done FROM events GROUP BY user_id")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running").otherwise("done")
    return desk.batch_progress(table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), status.alias("status")))


@_query("""SELECT tp, fn, fp, tn, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 4) AS recall, round(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 4) AS false_positive_rate, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 4) AS precision
  FROM (SELECT count(*) FILTER (t AND f) AS tp, count(*) FILTER (t AND NOT f) AS fn, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (NOT t AND NOT f) AS tn FROM (SELECT quality = 0 AS t, doc_id % 7 < 2 AS f FROM labels))""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.confusion(table(spark, sf_dir, "labels").select((F.col("quality") == 0).alias("truth"), (F.col("doc_id") % 7 < 2).alias("flagged")))


@_query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY CUBE (quality, toxic)")
def feedback_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").cube("quality", "toxic").agg(F.count("*").alias("n"))


@_query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.tumbling(table(spark, sf_dir, "events")).drop("total")


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  n AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS number FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM n GROUP BY user_id, number""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.sessions(table(spark, sf_dir, "events"))


@_query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15' AND user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 3)")
def retention_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    busy = rows.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3")
    return rows.where(F.to_date("ts") < F.lit("2024-01-15").cast("date")).join(busy, "user_id", "left_semi").select("event_id", "user_id")


@_query("SELECT user_id AS campaign, max(CAST(ts AS DATE)) AS last_seen FROM events GROUP BY user_id HAVING max(CAST(ts AS DATE)) <= DATE '2024-01-29'")
def stale_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("campaign")).agg(F.max(F.to_date("ts")).alias("last_seen"))
    return last.where(F.col("last_seen") <= F.lit("2024-01-29").cast("date"))


@_query("SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 1)")
def disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 1")
    return table(spark, sf_dir, "documents").join(marks, "doc_id", "left_semi").select("doc_id", "source", "lang")


@_query("SELECT c_custkey AS workspace, count(o_orderkey) AS n_messages FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def workspace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("workspace")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace")).join(counted, "workspace", "left").select("workspace", F.coalesce("n", F.lit(0)).cast("long").alias("n_messages"))


@_query(f"WITH {SQL_MESSAGES} SELECT msg_id, base FROM m WHERE starts_with(url, 'http://') OR msg_id IN (SELECT msg_id FROM m WHERE query LIKE '%utm%') ORDER BY msg_id DESC LIMIT 25 OFFSET 5")
def analysis_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    marked = rows.where(F.contains(F.col("query"), F.lit("utm"))).select("msg_id")
    found = rows.where(F.col("url").startswith("http://")).select("msg_id", "base").unionByName(rows.join(marked, "msg_id", "left_semi").select("msg_id", "base")).distinct()
    return found.orderBy(F.desc("msg_id")).offset(5).limit(25)


@_query(f"WITH {SQL_TRAITS}, c AS (SELECT kind, value, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 2) SELECT kind, value, n FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) <= 25")
def shared_traits_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = traits(messages(spark, sf_dir)).distinct().groupBy("kind", "value").agg(F.count("*").alias("n")).where("n >= 2")
    return lookups.budgeted(counted, ["kind"], [F.desc("n"), "value"], 25)


@_query(f"WITH {SQL_SIGNALS} SELECT msg_id, severity, label FROM s QUALIFY row_number() OVER (PARTITION BY msg_id, severity ORDER BY ord) = 1")
def first_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = signals(messages(spark, sf_dir)).groupBy("msg_id", "severity").agg(F.min_by("label", "ord").alias("label"))
    return kept.select("msg_id", "severity", "label")


@_query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS delay FROM events")
def hop_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", (F.col("ts").cast("timestamp").cast("long") - before.cast("timestamp").cast("long")).alias("delay"))


@_query("SELECT lang, source, count(*) AS n, count(*) FILTER (quality = 0) AS n_bad FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())")
def eval_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    sets = rows.groupingSets([["lang"], ["source"], []], "lang", "source")
    return sets.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("n_bad"))


@_query(f"WITH {SQL_MESSAGES}, c(base, status, age) AS (VALUES ('tionsh.top', 'ok', 10), ('tionsh.net', 'ok', 5000), ('tionsh.zip', 'error', 1)) SELECT msg_id, m.base, CASE WHEN status IN ('ok', 'not_found') AND age <= 3600 THEN status ELSE 'ask' END AS answer FROM m LEFT JOIN c ON c.base = m.base")
def cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _rows(spark, "base string, status string, age long", [("tionsh.top", "ok", 10), ("tionsh.net", "ok", 5000), ("tionsh.zip", "error", 1)])
    usable = F.broadcast(known.where("status IN ('ok', 'not_found') AND age <= 3600").select("base", "status"))  # three rows
    return messages(spark, sf_dir).select("msg_id", "base").join(usable, "base", "left").select("msg_id", "base", F.coalesce("status", F.lit("ask")).alias("answer"))


@_query(f"WITH {SQL_MESSAGES}, r AS (SELECT msg_id, 1 AS ord, base AS value, 'link' AS context FROM m UNION ALL SELECT msg_id, 2, host, 'host' FROM m) SELECT msg_id, value, string_agg(context, ', ' ORDER BY ord) AS context FROM r GROUP BY msg_id, value")
def ioc_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.col("base").alias("value"), F.lit("link").alias("context")), F.struct(F.lit(2).alias("ord"), F.col("host").alias("value"), F.lit("host").alias("context"))))
    rows = messages(spark, sf_dir).select("msg_id", parts.alias("r")).select("msg_id", "r.*")
    ordered = F.sort_array(F.collect_list(F.struct("ord", "context")))
    return rows.groupBy("msg_id", "value").agg(F.array_join(F.transform(ordered, lambda x: x["context"]), ", ").alias("context"))


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    verdict = F.when(F.col("msg_id") % 3 == 0, "MALICIOUS").when(F.col("msg_id") % 3 == 1, "SUSPICIOUS").otherwise("OTHER")
    kinds = F.explode(F.array(F.struct(F.lit("domain").alias("type"), F.col("host").alias("value")), F.struct(F.lit("phone").alias("type"), F.lit("1").alias("value"))))
    return rows.select(F.col("msg_id"), F.col("msg_id").alias("ord"), verdict.alias("verdict"), F.lit("link host").alias("context"), F.lit(None).cast("string").alias("filename"), F.col("subject"), F.lit("x.eml").alias("source_file"), kinds.alias("i")).select("*", "i.*").drop("i")


@_query(f"WITH {SQL_MESSAGES} SELECT 'domain' AS type, host AS value, '[domain-name:value = ' || chr(39) || host || chr(39) || ']' AS pattern, CASE min(msg_id) % 3 WHEN 0 THEN 85 WHEN 1 THEN 40 ELSE 20 END AS confidence FROM m GROUP BY host")
def stix_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.stix_indicators(_shared(spark, sf_dir)).select("type", "value", "pattern", "confidence")


@_query(f"WITH {SQL_MESSAGES} SELECT msg_id, 'domain' AS type, host AS value FROM m")
def misp_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.misp_attributes(_shared(spark, sf_dir))


@_query(f"WITH {SQL_MESSAGES} SELECT 'domain' AS type, host AS value, replace(host, '.', '[.]') AS defanged, 'link host' AS context, count(*) AS n FROM m GROUP BY host")
def csv_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sinks.csv_indicators(_shared(spark, sf_dir)).where("type = 'domain'")
    return made.groupBy("type", "value", "defanged", "context").agg(F.count("*").alias("n"))


@_query("SELECT page_id AS name, octet_length(encode(html)) AS size, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL")
def report_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest(table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.col("page_id").alias("name"), F.encode("html", "UTF-8").alias("content")))


@_query("SELECT lang AS batch, sha256(string_agg(h, chr(10) ORDER BY h)) AS stem FROM (SELECT lang, sha256(source) AS h FROM documents WHERE source IS NOT NULL) GROUP BY lang")
def batch_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.batch_stem(table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("lang").alias("batch"), F.sha2("source", 256).alias("sha256")))


@_query("""SELECT (SELECT count(*) FROM orders) AS copies, (SELECT count(DISTINCT o_custkey) FROM orders) AS mailboxes, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS unread,
  (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS replied, (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0) AS errors, (SELECT count(*) FROM customer WHERE c_custkey % 4 > 2) AS incomplete""")
def sweep_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mailbox"), F.when(F.col("c_custkey") % 7 == 0, F.lit("down")).alias("error"), F.when(F.col("c_custkey") % 4 > 2, 1).otherwise(0).alias("warnings"))
    return sinks.sweep_totals(boxes, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mailbox"), (F.col("o_orderstatus") != "O").alias("read"), (F.col("o_orderkey") % 5 == 0).alias("replied")))


@_query(f"WITH {SQL_MESSAGES}, h AS (SELECT msg_id, regexp_extract(base, '[^.]*$') AS base, host FROM m), p AS (SELECT base FROM h GROUP BY base HAVING base = 'top' OR (count(DISTINCT host) >= 5 AND count(DISTINCT host) >= 0.6 * count(DISTINCT msg_id))) SELECT DISTINCT msg_id, CASE WHEN base IN (SELECT base FROM p) THEN 'host' ELSE 'domain' END AS kind, CASE WHEN base IN (SELECT base FROM p) THEN host ELSE base END AS value FROM h")
def platform_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("msg_id", F.regexp_extract("base", r"[^.]*$", 0).alias("base"), "host")
    return C.demoted(rows, ("top",))


@_query(_SQL_CAMPAIGNS + """, s AS (SELECT c.campaign, t.kind, t.value, count(*) AS messages FROM t JOIN c USING (msg_id) GROUP BY ALL HAVING count(*) >= 2)
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY messages DESC, kind, value) <= 25""")
def campaign_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traits(messages(spark, sf_dir))
    return C.top_shared(C.campaigns(found), found)


@_query(f"WITH {SQL_MESSAGES} SELECT msg_id, base LIKE '%.top' AS malicious FROM m")
def malicious_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    answers = rows.select("base").distinct().select(F.col("base").alias("value"), F.lit("ok").alias("status"), F.when(F.col("base").endswith(".top"), 2).otherwise(1).alias("malicious"))
    bad = scoring.known_malicious(rows.select("msg_id", F.col("base").alias("value")), answers)
    return scoring.scored(rows, signals(rows), bad).select("msg_id", (F.col("verdict") == "MALICIOUS").alias("malicious"))
