"""Parsed mail to the facts that the rule catalogue judges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.functions import text as T
from lurescope.functions.auth import MECHANISMS, authentication
from lurescope.functions.wallets import wallets
from lurescope.operators.links import link_key, raw_links
from lurescope.sources.archives import expand
from lurescope.sources.mail import read_attachments
from lurescope.sources.markup import read_markup

#: Fixed value: characters without width, of which joiners count only inside Latin words.
ZERO_WIDTH = "[\\u200b\\u2060]|(?<=[A-Za-z])[\\u200c\\u200d](?=[A-Za-z])"


def message_facts(mail: DataFrame, trusted: tuple[str, ...] = ()) -> DataFrame:
    """Facts of the rows of ``parse_mail``, by msg_id: sender, reply address, body, authentication, wallets and number of links.

    ``trusted`` are the servers whose Authentication-Results count; without it, those at the top. Rows with an error have no
    facts. The body is the plain text, what the HTML shows, then what it hides. Facts that need another reader (display names,
    lists of the workspace) are left to the caller.
    """
    whole = mail.where(F.col("error").isNull())
    rows = whole.withColumn("seen", read_markup(F.col("html"), F.col("text")))
    body = F.trim(F.concat_ws(" ", F.trim(F.regexp_replace("text", r"\s+", " ")), "seen.visible", "seen.hidden"))
    unseen = sum(F.regexp_count(F.coalesce(c, F.lit("")), F.lit(ZERO_WIDTH)) for c in (F.col("text"), F.col("seen.text")))
    count = lambda name: F.coalesce(f"seen.{name}", F.lit(0))
    rows = rows.select(
        "msg_id", "from_address", "reply_to", "subject", body.alias("body"), authentication(F.col("headers"), trusted).alias("auth"), raw_links(F.col("text"), F.col("seen")).alias("links"),
        unseen.alias("zero_width"), *[count(n).alias(n) for n in ("hidden_splits", "tag_splits", "hidden_filler")], T.defang_text(F.coalesce("seen.hidden_claim", F.lit(""))).alias("hidden_claim"),
    )
    rows = rows.withColumn("found", wallets(F.col("body")))
    domain = lambda address: F.when(address.isNotNull(), T.domain_of_address(address))
    claims = lambda own: F.transform(F.filter("auth.forged", lambda f: f["impersonates"] == F.lit(own)), lambda f: f["claim"])
    return rows.select(
        "msg_id", "from_address", "subject", "body", domain(F.col("from_address")).alias("from_domain"),
        T.registrable_domain(domain(F.col("from_address"))).alias("from_base"), T.registrable_domain(domain(F.col("reply_to"))).alias("reply_base"),
        *[f"auth.{m}" for m in MECHANISMS[:3]], F.coalesce(*[f"auth.{m}" for m in MECHANISMS]).isNotNull().alias("auth_seen"),
        claims(True).alias("forged_claims"), claims(False).alias("earlier_claims"),
        F.transform("found", lambda w: w["currency"]).alias("wallets"), F.size(F.array_distinct(F.transform("links", lambda k: link_key(k["url"])))).alias("n_urls"),
        "zero_width", "hidden_splits", "tag_splits", "hidden_filler", "hidden_claim",
    )


def attachment_facts(files: DataFrame) -> DataFrame:
    """Facts of all attachments of ``read_mail``'s messages and of the files inside them, by msg_id."""
    held = read_attachments(files).select(F.concat_ws("/", "msg_id", F.col("part_no").cast("string")).alias("file_key"), "filename", "content")
    facts = file_facts(expand(held, "file_key"), "file_key")
    return facts.select(F.substring_index("file_key", "/", 1).alias("msg_id"), *[c for c in facts.columns if c != "file_key"])


def file_facts(found: DataFrame, key: str) -> DataFrame:
    """Facts of the rows of ``archives.expand``: types, archives, and the features of documents and of HTML.

    ``key`` names one expanded file; a message with several needs a key for each.
    """
    of = lambda kinds: F.when(F.col("true_type").isin(*kinds), F.col("features")).otherwise(F.array())
    valued = lambda name: F.transform(F.filter("features", lambda f: f.startswith(f"{name} ")), lambda f: F.substr(f, F.lit(len(name) + 2)))
    members = found.where("parent_no IS NOT NULL").groupBy(F.col(key).alias("_of"), F.col("parent_no").alias("_no")).agg(F.count("*").cast("int").alias("members"))
    rows = found.join(members, F.col(key).eqNullSafe(F.col("_of")) & (F.col("file_no") == F.col("_no")), "left").drop("_of", "_no")
    return rows.select(
        key, "filename", "true_type", F.col("kind").alias("archive_kind"), "encrypted", F.coalesce("members", F.lit(0)).alias("members"),
        of(("zip", "ole")).alias("office"), of(("pdf",)).alias("pdf"), of(("rtf",)).alias("rtf"), F.array_contains("features", "vba-macro").alias("macro"),
        F.array_contains("features", "password-form").alias("password_form"), F.array_contains("features", "scripts").alias("scripts"),
        F.size(valued("calls")).alias("smuggling"), F.coalesce(F.get(valued("redirect"), F.lit(0)), F.lit("")).alias("redirect"),
        F.exists(valued("decoded"), lambda plain: F.size(T.urls_from_text(plain)) > 0).alias("decoded"),
    )
