"""Signals to scores, verdicts and technique tags: one aggregation by message."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescope.functions import text as T
from lurescope.functions.text import signal_kind
from lurescope.plans import knowledge as K

#: What a signal adds to the score, and the verdicts from worst to best.
WEIGHTS = {"high": 3, "medium": 2}
LOW_CAP = 3
VERDICTS = ("MALICIOUS", "LIKELY PHISHING", "SUSPICIOUS", "NO STRONG INDICATORS")


def dedupe(signals: DataFrame) -> DataFrame:
    """The first signal of each label of a message, even if a later one is more severe."""
    w = Window.partitionBy("msg_id", "label").orderBy("ord")
    return signals.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scored(messages: DataFrame, signals: DataFrame, malicious: DataFrame | None = None) -> DataFrame:
    """msg_id, score, n_high, n_families, verdict of every message, also of those without signals.

    signals: msg_id, ord, severity, label, family. Lows count by distinct kind, three at most. Messages in ``malicious``
    (msg_id; of ``known_malicious``) are MALICIOUS whatever their score.
    """
    severity = F.col("severity")
    family = F.when((F.col("family") != "") & (severity != "low"), F.col("family"))
    points = F.sum(F.when(severity == "high", F.lit(WEIGHTS["high"])).when(severity == "medium", F.lit(WEIGHTS["medium"])).otherwise(F.lit(0)))
    lows = F.least(F.count_distinct(F.when(severity == "low", signal_kind(F.col("label")))), F.lit(LOW_CAP))
    found = dedupe(signals).groupBy("msg_id").agg(
        (points + lows).cast("long").alias("score"),
        F.count_if(severity == "high").alias("n_high"),
        F.count_if((severity == "high") & (F.col("family") != "")).alias("high_with_family"),
        F.count_distinct(family).alias("n_families"),
    )
    all_rows = messages.select("msg_id").join(found, "msg_id", "left").na.fill(0)
    all_rows = all_rows.withColumn("verdict", verdict()).drop("high_with_family")
    if malicious is None:
        return all_rows
    marked = all_rows.join(malicious.select("msg_id", F.lit(True).alias("_malicious")).distinct(), "msg_id", "left")
    return marked.withColumn("verdict", F.when(F.col("_malicious"), F.lit(VERDICTS[0])).otherwise(F.col("verdict"))).drop("_malicious")


def known_malicious(links: DataFrame, lookups: DataFrame, engines: int = 2) -> DataFrame:
    """msg_id of messages with a link or file that enough engines call malicious. links: msg_id, value; lookups: value, status, malicious."""
    bad = lookups.where((F.col("status") == "ok") & (F.col("malicious") >= engines)).select("value").distinct()
    return links.join(bad, "value", "left_semi").select("msg_id").distinct()


def verdict():
    corroborated = (F.col("high_with_family") > 0) & (F.col("n_families") >= 2)
    likely = (F.col("n_high") >= 2) | ((F.col("n_high") >= 1) & ((F.col("score") >= 8) | corroborated)) | ((F.col("n_families") >= 3) & (F.col("score") >= 8))
    return F.when(likely, F.lit(VERDICTS[1])).when((F.col("n_high") >= 1) | (F.col("score") >= 4), F.lit(VERDICTS[2])).otherwise(F.lit(VERDICTS[3]))


def techniques(signals: DataFrame) -> DataFrame:
    """msg_id, technique, n_signals."""
    return dedupe(signals).select("msg_id", F.explode("techniques").alias("technique")).groupBy("msg_id", "technique").agg(F.count("*").alias("n_signals"))


def indicators(rows: DataFrame) -> DataFrame:
    """(msg_id, type, value, contexts): each value once, its contexts in order. rows: msg_id, ord, type, value, context."""
    parts = F.transform(F.array_sort(F.collect_set(F.struct("ord", "context"))), lambda s: s["context"])
    return rows.groupBy("msg_id", "type", "value").agg(F.array_join(F.array_distinct(parts), ", ").alias("contexts"))


def indicator_rows(messages: DataFrame, links: DataFrame) -> DataFrame:
    """msg_id, ord, type, value, context of what is worth blocking or sharing, for ``indicators``.

    messages: msg_id, verdict, from_address, reply_to, trusted_from, origin_ip, shared_origin. links: msg_id, ord, url,
    trusted, only_headers, only_text, flagged, claimed (whether other links' texts claim its host). Nothing comes of a clean
    verdict. Links under private names, decoys that are only claimed, and a shared service's header links are left out;
    trusted ones stay where the place is rented (hosting). Domains of shorteners, free mail, shared services, trusted
    organisations and rented hosting are never given, their links and addresses are.
    """
    flagged = messages.where(F.col("verdict") != VERDICTS[-1])
    host, hosting = T.host_of(F.col("url")), T.hosting_kind(F.col("url"))
    base = T.registrable_domain(F.col("host"))
    shared = K.SHORTENERS + K.FREEMAIL + K.SHARED_INFRASTRUCTURE
    rows = links.join(flagged.select("msg_id"), "msg_id", "left_semi").withColumns({"host": host, "hosting": hosting}).withColumn("base", base)
    rows = rows.where(T.on_the_internet(F.col("host")) & ~(F.col("claimed") & ~F.col("flagged") & F.col("only_text")) & ~(F.col("only_headers") & F.col("base").isin(*K.SHARED_INFRASTRUCTURE)))
    urls = rows.where(~F.col("trusted") | (F.col("hosting") != "")).select("msg_id", "ord", F.lit("url").alias("type"), F.col("url").alias("value"), F.lit("link").alias("context"))
    kind = F.when(F.contains("host", F.lit(":")), "ipv6").when(F.col("host").rlike(r"^[0-9.]+$"), "ipv4").otherwise("domain")
    hosts = rows.where(~F.col("trusted") & ~F.col("base").isin(*shared) & ~F.col("hosting").isin("free hosting", "file sharing"))
    hosts = hosts.select("msg_id", (F.col("ord") + 2_000_000).alias("ord"), kind.alias("type"), F.col("host").alias("value"), F.lit("link host").alias("context"))
    parts = None
    for place, (name, context) in enumerate((("from_address", "sender"), ("reply_to", "reply-to"))):
        address, domain = F.lower(F.col(name)), T.domain_of_address(F.col(name))
        good = flagged.where(F.col(name).contains("@") & ~F.col("trusted_from") & T.on_the_internet(domain))
        mail = good.select("msg_id", F.lit(3_000_000 + place).cast("long").alias("ord"), F.lit("email").alias("type"), address.alias("value"), F.lit(context).alias("context"))
        site = good.where(~T.registrable_domain(domain).isin(*shared) & ~T.hosting_kind(F.concat(F.lit("https://"), domain, F.lit("/"))).isin("free hosting", "file sharing"))
        site = site.select("msg_id", F.lit(1_000_000 + place).cast("long").alias("ord"), F.lit("domain").alias("type"), domain.alias("value"), F.lit(f"{context} domain").alias("context"))
        parts = mail.unionByName(site) if parts is None else parts.unionByName(mail).unionByName(site)
    origin = flagged.where(F.col("origin_ip").isNotNull() & ~F.col("shared_origin")).select("msg_id", F.lit(4_000_000).cast("long").alias("ord"), F.when(F.contains("origin_ip", F.lit(":")), "ipv6").otherwise("ipv4").alias("type"), F.col("origin_ip").alias("value"), F.lit("originating IP").alias("context"))
    longs = lambda d: d.withColumn("ord", F.col("ord").cast("long"))
    return longs(urls).unionByName(longs(hosts)).unionByName(parts).unionByName(origin)
