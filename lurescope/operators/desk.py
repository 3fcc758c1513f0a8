"""What an analyst team's server asks of its tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_room(jobs: DataFrame, cap: int) -> DataFrame:
    """workspace, day, used, room under a daily cap. jobs: workspace, ts."""
    used = jobs.groupBy("workspace", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    return used.withColumn("room", F.greatest(F.lit(cap) - F.col("used"), F.lit(0)).cast("long"))


def latest(rows: DataFrame, by: str, order: list) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def trailing_count(by: str, ts: str, seconds: int) -> Column:
    """Rows of the group within the seconds before each row, itself included: a range window."""
    return F.count("*").over(Window.partitionBy(by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0))


def backoff(interval: Column, failures: Column, cap: int) -> Column:
    """The interval doubled for each failure, twelve at most, and capped."""
    return F.least(interval * F.pow(F.lit(2), F.least(failures, F.lit(12))).cast("long"), F.lit(cap))


def fair_claim(waiting: DataFrame, running: DataFrame, most: int, limit: int) -> DataFrame:
    """The next jobs: none of workspaces that run ``most`` already, first those that ran longest ago or never."""
    state = running.groupBy("workspace").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    rows = waiting.join(state.where(F.col("n") >= most).select("workspace"), "workspace", "left_anti")
    rows = rows.join(state.select("workspace", "last"), "workspace", "left")
    return rows.orderBy(F.asc_nulls_first("last"), "ts", "job").limit(limit)


def chain_links(log: DataFrame) -> DataFrame:
    """log, n, link: the hash that each entry of a log must carry, over the chain so far and its own body.

    A link is the SHA-256 of the one before (empty for the first), a line feed and the body, so that a change in any entry
    changes all links after it. That order is sequential by its nature: a log's entries are dealt together, sorted by n
    (and body, where n repeats) and streamed, with one link in memory. A null body counts as empty.
    """
    kind = {c: log.schema[c].dataType.simpleString() for c in ("log", "n")}
    dealt = log.select("log", "n", F.coalesce("body", F.lit("")).alias("body")).repartition("log").sortWithinPartitions("log", "n", "body")

    def run(batches):
        now, link = object(), ""
        for batch in batches:
            logs, links = batch.column("log").to_pylist(), []
            for name, body in zip(logs, batch.column("body").to_pylist()):
                if name != now:
                    now, link = name, ""
                link = hashlib.sha256(f"{link}\n{body}".encode("utf-8", "surrogatepass")).hexdigest()
                links.append(link)
            yield pa.RecordBatch.from_arrays([batch.column("log"), batch.column("n"), pa.array(links, pa.string())], ["log", "n", "link"])

    return dealt.mapInArrow(run, f"log {kind['log']}, n {kind['n']}, link string")


def verify_chain(log: DataFrame) -> DataFrame:
    """log, entries, first_broken (the least n whose ``link`` isn't what the chain says; null for a whole chain)."""
    said = log.select("log", "n", F.col("link").alias("said"))
    joined = chain_links(log).join(said, ["log", "n"])
    return joined.groupBy("log").agg(F.count("*").alias("entries"), F.min(F.when(~F.col("link").eqNullSafe(F.col("said")), F.col("n"))).alias("first_broken"))


def requeue(jobs: DataFrame, cutoff: Column, most: int = 3) -> DataFrame:
    """jobs with running ones of an old heartbeat put back, or failed once they have had ``most`` attempts. jobs: status, heartbeat, attempts."""
    stale = (F.col("status") == "running") & (F.col("heartbeat") < cutoff)
    return jobs.withColumn("status", F.when(stale & (F.col("attempts") >= most), "failed").when(stale, "queued").otherwise(F.col("status")))


def mailboxes_due(mailboxes: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Enabled mailboxes whose next poll is unset or past and that have no job waiting. mailboxes: mailbox, enabled, next_poll; jobs: mailbox."""
    due = mailboxes.where(F.col("enabled") & (F.col("next_poll").isNull() | (F.col("next_poll") <= now)))
    return due.join(jobs.select("mailbox").distinct(), "mailbox", "left_anti")


def batch_progress(members: DataFrame) -> DataFrame:
    """batch, total, open, done of the submissions in each batch. members: batch, status."""
    open_ones = F.count_if(F.col("status").isin("queued", "running"))
    return members.groupBy("batch").agg(F.count("*").alias("total"), open_ones.alias("open"), (open_ones == 0).alias("done"))


def verdict_counts(rows: DataFrame, verdicts: tuple[str, ...]) -> DataFrame:
    """verdict, messages: every verdict, also those that no message has, in the order given."""
    listed = rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(verdicts)], "verdict string, place int")
    counted = rows.groupBy("verdict").agg(F.count("*").alias("n"))
    return listed.join(counted, "verdict", "left").orderBy("place").select("verdict", F.coalesce("n", F.lit(0)).cast("long").alias("messages"))


def confusion(rows: DataFrame) -> DataFrame:
    """tp, fn, fp, tn, recall, false_positive_rate, precision of rows (truth, flagged), to four places, null over zero."""
    t, f = F.col("truth"), F.col("flagged")
    out = rows.agg(F.count_if(t & f).alias("tp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & f).alias("fp"), F.count_if(~t & ~f).alias("tn"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), 4)
    return out.withColumns({"recall": rate("tp", "fn"), "false_positive_rate": rate("fp", "tn"), "precision": rate("tp", "fp")})
