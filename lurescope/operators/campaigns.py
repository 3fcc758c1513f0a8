"""Messages that share traits, as campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescope.operators.components import connected_components
from lurescope.plans import knowledge as K

#: Kinds that link only together with another kind, and members of a weak group at most.
WEAK = ("subject", "display name", "originating IP")
WEAK_MEMBERS = 200
#: Message numbers that a range of campaigns is numbered in.
RANGE = 1_000_000


def platforms(hosts: DataFrame, known: tuple[str, ...] = K.KNOWN_PLATFORMS) -> DataFrame:
    """(base, messages, hosts) of bases used by many: known ones, and those with at least 5 hosts and 0.6 of the number of messages. hosts: msg_id, base, host."""
    found = hosts.groupBy("base").agg(F.count_distinct("msg_id").alias("messages"), F.count_distinct("host").alias("hosts"))
    return found.where(F.col("base").isin(*known) | ((F.col("hosts") >= 5) & (F.col("hosts") >= 0.6 * F.col("messages"))))


def demoted(hosts: DataFrame, known: tuple[str, ...] = K.KNOWN_PLATFORMS) -> DataFrame:
    """(msg_id, kind, value): a domain trait for each message and base, or host traits where the base is a platform. hosts: msg_id, base, host."""
    marked = hosts.join(platforms(hosts, known).select("base", F.lit(True).alias("platform")), "base", "left")
    shared = F.coalesce("platform", F.lit(False))
    return marked.select("msg_id", F.when(shared, "host").otherwise("domain").alias("kind"), F.when(shared, F.col("host")).otherwise(F.col("base")).alias("value")).distinct()


def strong_edges(traits: DataFrame) -> DataFrame:
    """(src, dst, kind): a star from each trait's first message to its others. traits: msg_id, kind, value."""
    rows = traits.where(~F.col("kind").isin(*WEAK)).distinct()
    first = rows.groupBy("kind", "value").agg(F.min("msg_id").alias("src"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, ["kind", "value"]).where("msg_id <> src").select("src", F.col("msg_id").alias("dst"), "kind")


def weak_edges(traits: DataFrame) -> DataFrame:
    """(src, dst, kinds): pairs that share two weak kinds or more.

    A pair of kinds makes a compound trait, so that the pairs come from a star per compound value and not from a
    self-join; which member is tied to which doesn't matter for components.
    """
    rows = traits.where(F.col("kind").isin(*WEAK)).distinct()
    crowd = rows.groupBy("kind", "value").count().where(F.col("count").between(2, WEAK_MEMBERS)).select("kind", "value")
    rows = rows.join(crowd, ["kind", "value"])
    listed = rows.groupBy("msg_id").agg(F.array_sort(F.collect_set(F.struct("kind", "value"))).alias("all"))
    pairs = listed.select("msg_id", F.explode("all").alias("a"), "all").select("msg_id", "a", F.explode("all").alias("b")).where("a.kind < b.kind")
    first = pairs.groupBy("a", "b").agg(F.min("msg_id").alias("src"))
    ties = pairs.join(first, ["a", "b"]).where("msg_id <> src")
    return ties.groupBy("src", F.col("msg_id").alias("dst")).agg(F.count("*").alias("kinds"))


def campaigns(traits: DataFrame) -> DataFrame:
    """(msg_id, campaign): the least message of the component, for messages linked with another."""
    edges = strong_edges(traits).select("src", "dst").unionByName(weak_edges(traits).select("src", "dst"))
    return connected_components(edges).select(F.col("node").alias("msg_id"), F.col("component").alias("campaign"))


def ranked(members: DataFrame) -> DataFrame:
    """campaign, size, name (C1 for the largest); ties by the least message.

    Campaigns of a size are numbered among themselves, after the number of larger ones, so that no task has all campaigns:
    sizes are few, and those of a size are cut into ranges by their least message.
    """
    sizes = members.groupBy("campaign").agg(F.count("*").alias("size"))
    cut = sizes.withColumn("part", F.floor(F.col("campaign") / RANGE))
    parts = cut.groupBy("size", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size"), "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("size", "part").orderBy("campaign"))
    numbered = cut.withColumn("within", within).join(parts.select("size", "part", before.alias("before")), ["size", "part"])
    return numbered.select("campaign", "size", F.concat(F.lit("C"), (F.col("before") + F.col("within")).cast("long").cast("string")).alias("name"))


def cluster_report(members: DataFrame, messages: DataFrame, verdicts: tuple[str, ...]) -> DataFrame:
    """campaign, size, senders, first_seen, last_seen, worst of each campaign. members: msg_id, campaign; messages: msg_id, sender, seen, verdict."""
    rows = members.join(messages, "msg_id")
    place = F.array_position(F.array(*map(F.lit, verdicts)), F.col("verdict"))
    worst = F.element_at(F.array(*map(F.lit, verdicts)), F.min(place).cast("int"))
    return rows.groupBy("campaign").agg(F.count("*").alias("size"), F.count_distinct("sender").alias("senders"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), worst.alias("worst"))


def top_shared(members: DataFrame, traits: DataFrame, most: int = 25) -> DataFrame:
    """campaign, kind, value, messages: traits that at least two messages of a campaign share, the most frequent first."""
    shared = traits.distinct().join(members, "msg_id").groupBy("campaign", "kind", "value").agg(F.count("*").alias("messages")).where("messages >= 2")
    w = Window.partitionBy("campaign").orderBy(F.desc("messages"), "kind", "value")
    return shared.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
