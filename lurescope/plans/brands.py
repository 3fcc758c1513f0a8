"""Lookalikes, claimed brands, public suffixes and sweeps over every page, with expectations written by hand or in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.operators import brands as B
from lurescope.plans.messages import SQL_MESSAGES, messages
from lurescope.runtime import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
BRANDS = [("northwind", 0, ["northwind.com", "northwind.de"], False), ("acme", 1, ["acme.com", "acmemail.net"], True), ("contoso", 2, ["contoso.com"], False)]
WORDS = ["login", "secure", "support", "account", "billing", "update"]
PROTECTED = ("ourfirm.co.uk", "longcompany.com")
#: Host, and the targets that it passes for with the method of each.
HOSTS = [
    ("www.northwind.com", ""), ("northwind.net", "northwind.com tld-swap"), ("northwind.fr", ""), ("northwind.co", "northwind.com tld-swap"),
    ("northwind-login.com", "northwind.com combosquat"), ("securenorthwind24.com", "northwind.com combosquat"), ("northwindpower.com", ""),
    ("n0rthwind.com", "northwind.com homoglyph"), ("northw1nd.com", "northwind.com homoglyph"), ("nothwind.com", "northwind.com typosquat"), ("norhtwind.com", "northwind.com typosquat"),
    ("north-wind.com", "northwind.com typosquat"), ("c0ntoso.org", "contoso.com homoglyph"), ("acme-support.com", "acme.com combosquat"), ("acmeria.com", ""),
    ("northwind.evil.net", "northwind.com subdomain"), ("acme.login.evil.net", "acme.com subdomain"), ("0urfirm.co.uk", "ourfirm.co.uk homoglyph"), ("ourfirm.com", "ourfirm.co.uk tld-swap"),
    ("our-firm.co.uk", "ourfirm.co.uk typosquat"), ("ourfirm-billing.com", "ourfirm.co.uk combosquat"), ("longcompony.com", "longcompany.com typosquat"), ("longcampony.net", "longcompany.com typosquat"),
    ("plain.org", ""), ("8.8.8.8", ""),
]
#: Facts of a message, and its brand signals as rule, severity, brand.
CLAIMS = [
    (("Northwind Billing", "", "evil.top", None, None, [], False), "14 high northwind"),
    (("Northwind Billing", "", "northwind.de", None, None, [], False), ""),
    (("Northwind Billing", "", "northwind.fr", None, None, [], False), ""),
    (("C0ntoso", "", "evil.top", None, None, [], False), "15 high contoso"),
    (("Ann", "Your Contoso account is locked", "evil.top", None, None, ["evil.net"], False), "20 medium contoso"),
    (("Ann", "Your Contoso account is locked", "evil.top", None, None, ["evil.net"], True), "20 high contoso"),
    (("Ann", "Your Contoso account is locked", "evil.top", None, None, ["contoso.com"], True), ""),
    (("Ann", "Contoso shares fall", "news.net", None, None, [], False), ""),
    (("Ann", "fwd", "corp.com", "Acme", "evil.top", [], False), "21 high acme"),
    (("Acmeria", "", "evil.top", None, None, [], False), ""),
]
_KINDS = "case_no long, display string, subject string, from_base string, forwarded_display string, forwarded_base string, link_bases array<string>, urgent boolean"


def _dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BRANDS, "brand string, ord int, domains array<string>, token_only boolean")


def lookalike_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.element_at(F.array(*[F.lit(h) for h, _ in HOSTS]), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    hosts = table(spark, sf_dir, "pages").select("page_id", given.alias("host"))
    return hosts.join(B.lookalike_domains(hosts.select("host"), _dimension(spark), WORDS, PROTECTED), "host").select("page_id", "target", "method")


QUERIES["lookalike_hosts"] = lookalike_hosts
ORACLE_SQL["lookalike_hosts"] = f"SELECT page_id, target, method FROM pages JOIN (VALUES {', '.join(str((i, *e.split())) for i, (_, e) in enumerate(HOSTS) if e)}) AS e(i, target, method) ON page_id % {len(HOSTS)} = i"


def brand_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = spark.createDataFrame([(i, *f) for i, (f, _) in enumerate(CLAIMS)], _KINDS)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), (F.col("page_id") % len(CLAIMS)).alias("case_no"))
    return B.brand_signals(pages.join(F.broadcast(facts), "case_no"), _dimension(spark))  # ten rows


QUERIES["brand_claims"] = brand_claims
ORACLE_SQL["brand_claims"] = f"SELECT page_id AS msg_id, rule, severity, brand FROM pages JOIN (VALUES {', '.join(str((i, int(e.split()[0]), *e.split()[1:])) for i, (_, e) in enumerate(CLAIMS) if e)}) AS e(i, rule, severity, brand) ON page_id % {len(CLAIMS)} = i"


#: Subject, display name, sender's domain, and the disguised words as place, word, brand.
DISGUISED = [
    (("Your C0ntoso plan", "", "evil.top"), "subject C0ntoso contoso"), (("Contoso plan", "contoso", "evil.top"), ""), (("hi", "N0RTHWIND", "evil.top"), "display name N0RTHWIND northwind"),
    (("contos0 contos0", "C0ntos0", "a.net"), "subject contos0 contoso; display name C0ntos0 contoso"), (("C0ntoso", "", "contoso.com"), ""), (("4cme", "", "evil.top"), ""), (("Contos9", "", "evil.top"), ""), ((None, "x", None), ""),
]
#: Sender's host, host of a link, and the signals as severity, family, place, target, method.
NAMED = [
    ("northwind.net", "plain.org", "medium sender sender northwind.com tld-swap"), ("plain.org", "acme.org", "low link url acme.com tld-swap"), ("a.n0rthwind.com", "b.n0rthwind.com", "high sender sender northwind.com homoglyph"),
    ("plain.org", "northwind-login.com", "medium link url northwind.com combosquat"), ("plain.org", "ourfirm-billing.com", "high link url ourfirm.co.uk combosquat"), ("northwind.evil.net", "plain.org", "low sender sender northwind.com subdomain"),
    ("plain.org", "northwind.com.evil.net", "high link url northwind.com subdomain"), ("plain.org", "northwind.evil.top", "high link url northwind.com subdomain"), ("plain.org", "northwind.my-login.net", "high link url northwind.com subdomain"),
    ("nothwind.com", "nothwind.com", "high sender sender northwind.com typosquat"), ("norhtwind.com", "partner.net", "high sender sender northwind.com typosquat"), ("plain.org", "8.8.8.8", ""),
]


def disguised_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = spark.createDataFrame([(i, *f) for i, (f, _) in enumerate(DISGUISED)], "case_no long, subject string, display string, from_base string")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), (F.col("page_id") % len(DISGUISED)).alias("case_no"))
    return B.disguised_words(pages.join(F.broadcast(facts), "case_no"), _dimension(spark))  # a few rows


QUERIES["disguised_brands"] = disguised_brands
_DISGUISES = ", ".join(str((i, "display name" if one.startswith("d") else "subject", *one.split()[-2:])) for i, (_, e) in enumerate(DISGUISED) for one in e.split("; ") if one)
ORACLE_SQL["disguised_brands"] = f"SELECT page_id AS msg_id, 8 AS rule, 'high' AS severity, brand, place, word FROM pages JOIN (VALUES {_DISGUISES}) AS e(i, place, word, brand) ON page_id % {len(DISGUISED)} = i"


def lookalike_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = spark.createDataFrame([(i, *hosts) for i, (*hosts, _) in enumerate(NAMED)], "case_no long, sender string, url string")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), (F.col("page_id") % len(NAMED)).alias("case_no"))
    named = pages.join(F.broadcast(facts), "case_no").unpivot("msg_id", ["sender", "url"], "place", "host")  # a dozen rows
    return B.lookalike_signals(named, _dimension(spark), WORDS, PROTECTED, ("partner.net",)).select("msg_id", "severity", "family", "place", "target", "method")


QUERIES["lookalike_signals"] = lookalike_signals
ORACLE_SQL["lookalike_signals"] = f"SELECT page_id AS msg_id, severity, family, place, target, method FROM pages JOIN (VALUES {', '.join(str((i, *e.split())) for i, (_, _, e) in enumerate(NAMED) if e)}) AS e(i, severity, family, place, target, method) ON page_id % {len(NAMED)} = i"


def public_suffix_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([(x,) for x in ("// a list", "top", "com", "uk", "co.uk", "net", "*.zip")], "value string")
    return B.by_public_suffix(messages(spark, sf_dir).select("host"), B.read_suffixes(lines))


QUERIES["public_suffix_domains"] = public_suffix_domains
ORACLE_SQL["public_suffix_domains"] = f"WITH {SQL_MESSAGES} SELECT DISTINCT host, CASE WHEN host LIKE '%.co.uk' OR host LIKE '%.zip' THEN array_to_string((string_split(host, '.'))[-3:], '.') ELSE array_to_string((string_split(host, '.'))[-2:], '.') END AS domain FROM m"


def sweep_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select(F.col("msg_id").alias("id"), F.concat(F.lit("M"), (F.col("msg_id") % 9).cast("string"), F.lit("@"), "host").alias("sender"), F.concat(F.lit("Re: order number "), (F.col("msg_id") % 3).cast("string"), F.lit(" of group "), F.when(F.col("msg_id") % 4 == 0, "blue").otherwise("red")).alias("subject"))
    one = lambda *values: spark.createDataFrame([(v,) for v in values], "value string")
    return B.sweep(rows, one("m1@tionsh.top"), one("zip", "co.uk"), one("Order number 77 of group BLUE"))


QUERIES["sweep_matches"] = sweep_matches
ORACLE_SQL["sweep_matches"] = f"""WITH {SQL_MESSAGES}, f AS (SELECT msg_id AS id, 'domain' AS label FROM m WHERE host LIKE '%.zip' OR host LIKE '%.co.uk' UNION SELECT msg_id, 'subject' FROM m WHERE msg_id % 4 = 0 UNION SELECT msg_id, 'sender' FROM m WHERE host = 'tionsh.top' AND msg_id % 9 = 1)
  SELECT id, string_agg(label, ', ' ORDER BY label) AS matched FROM f GROUP BY id"""
