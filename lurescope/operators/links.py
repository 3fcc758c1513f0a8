"""Links of messages: where each comes from, what it hides, and the facts that link rules judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurescope.functions import text as T
from lurescope.plans import knowledge as K
from lurescope.sources.markup import read_markup

#: Links of a message that are judged, sources and texts of a link, characters of a text, and layers that are unwrapped.
LINKS, CONTEXTS, TEXT_CHARS, LAYERS = 1000, 20, 500, 3
#: Fixed value: beginnings of what no browser fetches.
SKIPPED = r"(?i)^(?:mailto:|tel:|cid:|data:|#|javascript:|blob:|about:)"
#: Fixed value: links that run script or open a page made of the link itself.
SCRIPTED = r"(?i)^\s*(?:javascript:(?!\s*(?:void\s*\(\s*0?\s*\)|;|$|return\s+false))|data:\s*(?:text/html|application/xhtml|image/svg|text/javascript))"
#: Hosts that may wrap links; all others are spared the rules of ``unwrap_link``.
_WRAPS = r"(?i)safelinks|urldefense|cudasvc|google\.|bing\.com|facebook\.com|youtube\.com|linkedin\.com"
_SHOWN_HOST = r"(?i)(?:https?://)?((?:[a-z0-9-]+\.)+[a-z]{2,24})"
_PLACE = "struct<source:string,url:string,shown:string,redirect_to:string,wrapped_by:string>"


def link_key(url: Column) -> Column:
    """What links that count as one share."""
    return F.lower(F.regexp_replace(url, "/+$", ""))


def _from(found: Column, source: str, url=lambda v: v, shown=lambda v: F.lit("")) -> Column:
    return F.transform(found, lambda v: F.struct(F.lit(source).alias("source"), url(v).alias("url"), shown(v).alias("shown")))


def raw_links(text: Column, seen: Column) -> Column:
    """(source, url, shown) of all usable links of a text and of ``read_markup``'s fields, in that order, cleaned and not unwrapped."""
    given = [
        _from(seen["anchors"], "html-href", lambda a: a["href"], lambda a: F.left(a["shown"], F.lit(TEXT_CHARS))), _from(seen["resources"], "html-resource"),
        _from(seen["redirects"], "html-redirect"), _from(seen["forms"], "html-form-action", lambda f: f["action"]),
    ]
    fetched = F.filter(F.flatten(F.filter(F.array(*given), lambda g: g.isNotNull())), lambda k: ~k["url"].rlike(SKIPPED))
    cleaned = F.transform(fetched, lambda k: F.struct(k["source"].alias("source"), T.clean_url(T.refang(k["url"])).alias("url"), k["shown"].alias("shown")))
    parts = _from(T.urls_from_text(text), "body-text"), F.filter(cleaned, lambda k: T.usable_url(k["url"])), _from(T.urls_from_text(seen["text"]), "html-text")
    return F.concat(*parts)


def unwrapped(link: Column) -> Column:
    """All links that one stands for: itself behind its gateways, or each redirector with its target, ``LAYERS`` deep at most."""

    def peel(now: Column, _) -> Column:
        def opened(w: Column) -> Column:
            gate = w["kind"] == "gateway"
            source = F.when(gate, F.concat(now["source"], F.lit(" via "), w["who"])).otherwise(F.concat(F.lit("redirect target ("), w["who"], F.lit(")")))
            outer = F.struct(now["source"].alias("source"), now["url"].alias("url"), now["shown"].alias("shown"), w["inner"].alias("redirect_to"), w["who"].alias("wrapped_by"))
            passed = F.when(gate, now["passed"]).otherwise(F.concat(now["passed"], F.array(outer)))
            inner = F.struct(source.alias("source"), w["inner"].alias("url"), F.when(gate, now["shown"]).otherwise(F.lit("")).alias("shown"), passed.alias("passed"))
            return F.when(w.isNull(), now).otherwise(inner)

        return F.when(now["url"].rlike(_WRAPS), T.let(T.unwrap_link(now["url"]), opened)).otherwise(now)

    def ended(now: Column) -> Column:
        last = F.struct(now["source"].alias("source"), now["url"].alias("url"), now["shown"].alias("shown"), F.lit("").alias("redirect_to"), F.lit("").alias("wrapped_by"))
        return F.concat(now["passed"], F.array(last))

    start = F.struct(link["source"].alias("source"), link["url"].alias("url"), link["shown"].alias("shown"), F.array().cast(f"array<{_PLACE}>").alias("passed"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LAYERS)), start, peel, ended)


def message_links(mail: DataFrame) -> DataFrame:
    """A row for each link of the rows of ``parse_mail``: msg_id, url as first written, host, domain, sources, texts, redirect_to, wrapped_by, n, place.

    Links that differ by case or final slashes are one; n counts its places. place is the link's number in its message by
    first mention, and links behind ``LINKS`` aren't judged, but none is lost. Copies of a message count once: they meet as
    one row for each place of a link, map-side first, so that a message in very many mailboxes is no hot key.
    """
    rows = mail.where(F.col("error").isNull()).withColumn("seen", read_markup(F.col("html"), F.col("text")))
    rows = rows.select("msg_id", F.posexplode(raw_links(F.col("text"), F.col("seen"))).alias("ord", "link"))
    rows = rows.select("msg_id", "ord", F.posexplode(unwrapped(F.col("link"))).alias("layer", "k"))
    rows = rows.groupBy("msg_id", (F.col("ord").cast("long") * (LAYERS + 1) + F.col("layer")).alias("ord")).agg(F.first("k").alias("k"))
    rows = rows.withColumn("key", link_key(F.col("k.url")))
    held = F.array_sort(F.collect_list(F.struct("ord", "k")))
    found = rows.groupBy("msg_id", "key").agg(held.alias("held"), F.count("*").alias("n"))
    each = lambda name: F.array_distinct(F.filter(F.transform("held", lambda h: h["k"][name]), lambda v: v != ""))
    last = lambda name: F.coalesce(F.try_element_at(F.filter(F.transform("held", lambda h: h["k"][name]), lambda v: v != ""), F.lit(-1)), F.lit(""))
    found = found.select(
        "msg_id", F.get("held", F.lit(0))["k"]["url"].alias("url"), F.slice(each("source"), 1, CONTEXTS).alias("sources"), F.slice(each("shown"), 1, CONTEXTS).alias("texts"),
        last("redirect_to").alias("redirect_to"), last("wrapped_by").alias("wrapped_by"), "n", F.get("held", F.lit(0))["ord"].alias("ord"),
    )
    place = F.row_number().over(Window.partitionBy("msg_id").orderBy("ord"))
    host = T.host_of(F.col("url"))
    return found.select("msg_id", "url", host.alias("host"), T.registrable_domain(host).alias("domain"), "sources", "texts", "redirect_to", "wrapped_by", "n", place.alias("place"))


def script_links(mail: DataFrame) -> DataFrame:
    """msg_id, url of links that run script or hold a whole page, each once, for the link rules."""
    rows = mail.where(F.col("error").isNull()).select("msg_id", F.explode(read_markup(F.col("html"))["anchors"]["href"]).alias("url"))
    return rows.where(F.col("url").rlike(SCRIPTED)).distinct()


def dropped_links(links: DataFrame) -> DataFrame:
    """msg_id, urls_dropped, urls_checked of messages with more than ``LINKS`` links; links that repeat count each time."""
    counts = links.groupBy("msg_id").agg(F.sum(F.when(F.col("place") > LINKS, F.col("n")).otherwise(0)).cast("int").alias("urls_dropped"), F.lit(LINKS).alias("urls_checked"))
    return counts.where("urls_dropped > 0")


def link_facts(links: DataFrame, trusted: tuple[str, ...] = ()) -> DataFrame:
    """Facts of the judged rows of ``message_links``; ``trusted`` are registrable domains.

    ``shown`` is the first text that names another domain than the link's, else the first. A link is clicked unless all its
    sources are resources or headers.
    """
    known = lambda domain: domain.isin(*trusted) if trusted else F.lit(False)
    base = lambda text: T.registrable_domain(F.lower(F.regexp_extract(text, _SHOWN_HOST, 1)))
    other = F.filter("texts", lambda t: T.let(base(t), lambda b: (b != "") & (b != F.col("domain"))))
    shown = F.coalesce(F.get(other, F.lit(0)), F.get("texts", F.lit(0)), F.lit(""))
    target = T.host_of(F.col("redirect_to"))
    rows = links.where(F.col("place") <= LINKS).withColumn("shown", shown)
    return rows.select(
        "msg_id", "url", "shown", target.alias("redirect_to"), "wrapped_by", known(F.col("domain")).alias("trusted"), known(T.registrable_domain(target)).alias("target_trusted"),
        F.exists("sources", lambda s: ~F.contains(s, F.lit("resource")) & ~s.startswith("header:")).alias("clicked"),
        (base(F.col("shown")).isin(*K.FREEMAIL) | known(base(F.col("shown")))).alias("shown_known"),
    )
