"""Reports: JSON lines, CSV that spreadsheets can open safely, shared indicators, STIX and MISP objects, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurescope.functions.text import csv_safe, defang_host, defang_url

#: STIX patterns by indicator type, and confidence by verdict (20 for others).
PATTERNS = {"url": "[url:value = '%s']", "domain": "[domain-name:value = '%s']", "ipv4": "[ipv4-addr:value = '%s']", "ipv6": "[ipv6-addr:value = '%s']", "email": "[email-addr:value = '%s']", "sha256": "[file:hashes.'SHA-256' = '%s']"}
CONFIDENCE = {"MALICIOUS": 85, "LIKELY PHISHING": 70, "SUSPICIOUS": 40}
#: The namespace of this library's STIX identifiers.
NAMESPACE = "8f0e3c52-41f7-4d0b-9a55-6b1d2f7c9e10"
#: MISP attribute types.
MISP_TYPES = {"url": "url", "domain": "domain", "ipv4": "ip-dst", "ipv6": "ip-dst", "email": "email-src", "sha256": "sha256"}


def write_json(reports: DataFrame, path: str) -> None:
    reports.drop("body_text").write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.select(*[csv_safe(F.col(c).cast("string")).alias(c) for c in rows.columns]).write.option("header", "true").csv(path)


def shared_indicators(rows: DataFrame) -> DataFrame:
    """type, value, msg_id of the first message that has each value. rows: msg_id, type, value."""
    w = Window.partitionBy("type", "value").orderBy("msg_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name, by built-in functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def defanged(kind: Column, value: Column) -> Column:
    return F.when(kind == "url", defang_url(value)).when(kind == "sha256", value).otherwise(defang_host(value))


def csv_indicators(rows: DataFrame) -> DataFrame:
    """type, value, defanged, context, verdict, subject, source_file with cells that are no formulas. rows: those but defanged."""
    made = rows.withColumn("defanged", defanged(F.col("type"), F.col("value")))
    return made.select(*[csv_safe(F.col(c).cast("string")).alias(c) for c in ("type", "value", "defanged", "context", "verdict", "subject", "source_file")])


def stix_indicators(rows: DataFrame) -> DataFrame:
    """id, object (JSON) of each distinct indicator; the first message that has it gives the rest. rows: ord, type, value, context, verdict, subject."""
    known = rows.where(F.col("type").isin(*PATTERNS))
    w = Window.partitionBy("type", "value").orderBy("ord")
    first = known.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    value = F.replace(F.replace(F.col("value"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    pattern = confidence = None
    for kind, made in PATTERNS.items():
        start, end = made.split("%s")
        text = F.concat(F.lit(start), value, F.lit(end))
        pattern = F.when(F.col("type") == kind, text) if pattern is None else pattern.when(F.col("type") == kind, text)
    for verdict, points in CONFIDENCE.items():
        confidence = F.when(F.col("verdict") == verdict, points) if confidence is None else confidence.when(F.col("verdict") == verdict, points)
    number = F.concat(F.lit("indicator--"), uuid5(NAMESPACE, F.concat_ws("|", F.lit("indicator"), "type", "value")))
    kind = F.when(F.col("verdict").isin("MALICIOUS", "LIKELY PHISHING"), "malicious-activity").otherwise("anomalous-activity")
    body = F.to_json(F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), number.alias("id"), F.concat(F.lit("Phishing "), "type", F.lit(": "), defanged(F.col("type"), F.col("value"))).alias("name"), F.array(kind).alias("indicator_types"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"), confidence.otherwise(20).alias("confidence"), F.array(F.lit("phishing")).alias("labels")))
    return first.select("type", "value", number.alias("id"), pattern.alias("pattern"), confidence.otherwise(20).alias("confidence"), body.alias("object"))


def misp_attributes(rows: DataFrame) -> DataFrame:
    """msg_id, type, value of MISP attributes. rows: msg_id, type, value, context, filename.

    An originating address is ip-src, and ip-dst too where it is a link's host; a file hash comes with its name as well.
    """
    plain = None
    for kind, name in MISP_TYPES.items():
        plain = F.when(F.col("type") == kind, name) if plain is None else plain.when(F.col("type") == kind, name)
    contexts = F.split("context", ", ")
    ip, origin = F.col("type").isin("ipv4", "ipv6"), F.array_contains(contexts, "originating IP")
    first = F.when(ip & origin, F.lit("ip-src")).otherwise(plain)
    second = F.when(ip & origin & (F.size(contexts) > 1), F.struct(F.lit("ip-dst").alias("type"), F.col("value").alias("value")))
    named = F.when((F.col("type") == "sha256") & F.col("filename").isNotNull(), F.struct(F.lit("filename|sha256").alias("type"), F.concat_ws("|", "filename", "value").alias("value")))
    each = F.array_compact(F.array(F.when(first.isNotNull(), F.struct(first.alias("type"), F.col("value").alias("value"))), second, named))
    return rows.select("msg_id", F.explode(each).alias("a")).select("msg_id", "a.type", "a.value")


def manifest(files: DataFrame) -> DataFrame:
    """name, size, sha256 of each file of a report. files: name, content."""
    return files.select("name", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def batch_stem(rows: DataFrame) -> DataFrame:
    """batch, stem: the hash of a batch's sorted report hashes, whatever the order they came in. rows: batch, sha256."""
    return rows.groupBy("batch").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n"), 256).alias("stem"))


def sweep_totals(boxes: DataFrame, matches: DataFrame) -> DataFrame:
    """copies, mailboxes, unread, replied, errors, incomplete of a sweep. boxes: mailbox, error, warnings; matches: mailbox, read, replied."""
    found = matches.agg(F.count("*").alias("copies"), F.count_distinct("mailbox").alias("mailboxes"), F.count_if(~F.col("read")).alias("unread"), F.count_if("replied").alias("replied"))
    state = boxes.agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("warnings") > 0).alias("incomplete"))
    return found.join(F.broadcast(state), F.lit(True))  # one row each
