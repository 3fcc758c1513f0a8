"""Authentication headers and alignment as column expressions over a message's headers in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurescope.functions.text import let, registrable_domain

MECHANISMS = ("spf", "dkim", "dmarc", "compauth")
#: The properties that name what a check vouched for, the first present one first.
PROPERTIES = {"spf": ("smtp.mailfrom", "smtp.helo"), "dkim": ("header.d", "header.i"), "dmarc": ("header.from",)}
#: Forged claims and checks that a message keeps; a Received-SPF header counts at most so many headers from the trusted ones.
FORGED, CHECKS, NEAR = 20, 20, 3
CHECK = r"(?i)^(spf|dkim|dmarc)\s*=\s*([a-z]+)"
LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"

_CLAIMS = "array<struct<claim:string,server:string,impersonates:boolean>>"
_CHECKED = "array<struct<method:string,result:string,domain:string>>"


def _named(value: Column) -> Column:
    """The host of an address or name; empty if it isn't one."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), r'^["<>]+|["<>]+$', ""), r"^.*@", "")
    return let(F.regexp_replace(F.lower(bare), r"\.+$", ""), lambda host: F.when((F.length(host) <= 253) & host.rlike(rf"^{LABEL}(?:\.{LABEL})+$"), host).otherwise(""))


def _no_comments(value: Column) -> Column:
    for _ in range(4):  # comments may nest
        value = F.regexp_replace(value, r"\([^()]*\)", " ")
    return value


def _server(value: Column) -> Column:
    return F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1))))


def _check(clause: Column) -> Column:
    method = F.lower(F.regexp_extract(clause, CHECK, 1))
    domain = F.lit("")
    for name, properties in PROPERTIES.items():
        found = F.coalesce(*[F.nullif(F.regexp_extract(clause, rf"(?i)\b{p.replace('.', chr(92) + '.')}\s*=\s*([^\s;]+)", 1), F.lit("")) for p in properties], F.lit(""))
        domain = F.when(method == name, found).otherwise(domain)
    return F.struct(method.alias("method"), F.lower(F.regexp_extract(clause, CHECK, 2)).alias("result"), _named(domain).alias("domain"))


def _checks(block: Column) -> Column:
    clauses = F.flatten(F.transform(block, lambda h: F.transform(F.split(_no_comments(h["value"]), ";"), lambda c: F.ltrim(c))))
    return F.transform(F.filter(clauses, lambda c: c.rlike(CHECK)), _check)


def _forged(outside: Column, found: Column, receiver: Column) -> Column:
    def claims(header: Column) -> Column:
        one = lambda m: F.struct(F.lit(f"{m}=pass").alias("claim"), F.substring(header["server"], 1, 80).alias("server"), F.coalesce(header["server"] == receiver, F.lit(False)).alias("impersonates"))
        is_claimed = lambda m: header["value"].rlike(rf"(?i)\b{m}\s*=\s*pass\b") & (F.coalesce(found[m], F.lit("")) != "pass")
        return F.array_compact(F.array(*[F.when(is_claimed(m), one(m)) for m in MECHANISMS[:3]]))

    return F.aggregate(outside, F.array().cast(_CLAIMS), lambda kept, h: F.when(F.size(kept) >= FORGED, kept).otherwise(F.concat(kept, claims(h)).cast(_CLAIMS)))


def _received(items: Column, block: Column) -> Column:
    """The topmost Received-SPF as a check, if it stands near the trusted headers or there are none; else null."""
    first = F.get(F.filter(items, lambda h: (h["name"] == "received-spf") & (h["value"] != "")), F.lit(0))

    def read(h: Column) -> Column:
        place = r'(?i)envelope-from\s*=\s*"?([^\s;"]{1,320})|domain of\s+(\S{1,320})\s+(?:designates|does not designate)'
        result = F.regexp_replace(F.lower(F.split_part(h["value"], F.lit(" "), F.lit(1))), "^;+|;+$", "")
        domain = F.concat(F.regexp_extract(h["value"], place, 1), F.regexp_extract(h["value"], place, 2))
        near = (F.size(block) == 0) | (F.abs(h["at"] - F.get(block, F.lit(0))["at"]) <= NEAR)
        return F.when(h.isNotNull() & near, F.struct(F.lit("spf").alias("method"), result.alias("result"), _named(domain).alias("domain")))

    return let(first, read)


def authentication(headers: Column, trusted: tuple[str, ...] = ()) -> Column:
    """What the receiving server found of a message, and what was claimed in its place.

    headers is array<struct<name, value>> in the message's order. Only the unbroken block of Authentication-Results headers
    of one server at the top counts, or with ``trusted`` only headers of those servers: lower ones come from the sender.
    Gives spf, dkim, dmarc, compauth (null if absent), forged (claims of a pass that the receiver doesn't report), checks
    (method, result, domain), header and receiver (where the results come from; empty if none). Null headers: as none.
    """
    flat = lambda v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"\s+", " "))
    headers = F.coalesce(headers, F.array().cast("array<struct<name:string,value:string>>"))
    items = F.transform(headers, lambda h, i: F.struct(i.alias("at"), F.lower(h["name"]).alias("name"), flat(h["value"]).alias("value"), _server(flat(h["value"])).alias("server")))

    def read(items: Column) -> Column:
        results = F.filter(items, lambda h: h["name"] == "authentication-results")
        if trusted:
            inside = lambda h: h["server"].isin(*trusted)
            return let(F.struct(F.filter(results, inside).alias("block"), F.filter(results, lambda h: ~inside(h)).alias("outside")), lambda split: whole(items, split))

        def cut(found: Column) -> Column:
            top = F.get(found, F.lit(0))
            breaks = F.filter(items, lambda h: (h["at"] > top["at"]) & ~((h["name"] == "authentication-results") & (h["server"] == top["server"])))
            stop = F.coalesce(F.get(breaks, F.lit(0))["at"], F.size(items))
            return let(stop, lambda end: F.struct(F.filter(found, lambda h: h["at"] < end).alias("block"), F.filter(found, lambda h: h["at"] >= end).alias("outside")))

        return let(let(results, cut), lambda split: whole(items, split))

    def whole(items: Column, split: Column) -> Column:
        block = split["block"]
        first = lambda m: F.get(F.filter(F.transform(block, lambda h: F.lower(F.regexp_extract(h["value"], rf"(?i)\b{m}\s*=\s*([a-z]+)", 1))), lambda v: v != ""), F.lit(0))
        found = F.struct(*[first(m).alias(m) for m in MECHANISMS])
        return let(F.struct(found.alias("found"), _received(items, block).alias("received")), lambda s: told(split, s["found"], F.when(s["found"]["spf"].isNull(), s["received"])))

    def told(split: Column, found: Column, received: Column) -> Column:
        block = split["block"]
        top = F.get(block, F.lit(0))
        name = let(F.trim(F.split_part(_no_comments(top["value"]), F.lit(";"), F.lit(1))), lambda n: F.when(n.rlike(CHECK), "").otherwise(F.substring(F.lower(n), 1, 80)))
        seen = let(_checks(block), lambda c: F.when(received.isNotNull() & ~F.exists(c, lambda x: x["method"] == "spf"), F.concat(F.array(received).cast(_CHECKED), c.cast(_CHECKED))).otherwise(c.cast(_CHECKED)))
        return F.struct(
            F.coalesce(found["spf"], received["result"]).alias("spf"), *[found[m].alias(m) for m in MECHANISMS[1:]],
            _forged(split["outside"], found, top["server"]).alias("forged"), F.slice(seen, 1, CHECKS).alias("checks"),
            F.when(F.size(block) > 0, "Authentication-Results").when(received.isNotNull(), "Received-SPF").otherwise("").alias("header"),
            F.coalesce(name, F.lit("")).alias("receiver"),
        )

    return let(items, read)


def alignment(auth: Column, sender: Column, bounce: Column) -> Column:
    """status (pass, fail, unknown) and the spf, dkim and dmarc rows: result, domain, aligned (null if no domain is known).

    sender and bounce are the domains of From and Return-Path; null and empty are alike. A check counts for the sender if its
    domain belongs to the same organisation. DMARC decides where it has passed or failed, an aligned pass elsewhere. Without
    any result the status is unknown and the rows are null.
    """
    base = lambda c: F.coalesce(c, F.lit(""))
    given = F.struct(auth.alias("auth"), base(sender).alias("sender"), registrable_domain(base(sender)).alias("own"), base(bounce).alias("bounce"))
    return let(given, lambda g: _aligned(g["auth"], g["sender"], g["own"], g["bounce"]))


def _aligned(auth: Column, sender: Column, own: Column, bounce: Column) -> Column:
    same = lambda domain: (domain != "") & (sender != "") & (registrable_domain(domain) == own)
    row = lambda result, domain: F.struct(F.coalesce(F.nullif(result, F.lit("")), F.lit("none")).alias("result"), domain.alias("domain"), F.when(domain != "", same(domain)).alias("aligned"))
    of = lambda method: F.filter(auth["checks"], lambda c: c["method"] == method)
    named = lambda method, other: F.coalesce(F.nullif(F.get(of(method), F.lit(0))["domain"], F.lit("")), other)
    passes = F.filter(of("dkim"), lambda c: c["result"] == "pass")
    signature = F.coalesce(F.get(F.filter(passes, lambda c: same(c["domain"])), F.lit(0)), F.get(passes, F.lit(0)), F.get(of("dkim"), F.lit(0)))
    spf = let(named("spf", bounce), lambda domain: row(auth["spf"], domain))
    dkim = let(signature, lambda s: row(F.coalesce(s["result"], auth["dkim"]), F.coalesce(s["domain"], F.lit(""))))
    dmarc = F.struct(F.coalesce(auth["dmarc"], F.lit("none")).alias("result"), named("dmarc", sender).alias("domain"))

    def judged(rows: Column) -> Column:
        aligned = F.coalesce((rows["spf"]["result"] == "pass") & rows["spf"]["aligned"], F.lit(False)) | F.coalesce((rows["dkim"]["result"] == "pass") & rows["dkim"]["aligned"], F.lit(False))
        status = F.when(F.coalesce(*[auth[m] for m in MECHANISMS]).isNull(), "unknown").when(auth["dmarc"].isin("pass", "fail"), auth["dmarc"]).when(aligned, "pass").otherwise("fail")
        return let(status, lambda known: F.struct(known.alias("status"), *[F.when(known != "unknown", rows[m]).alias(m) for m in MECHANISMS[:3]]))

    return let(F.struct(spf.alias("spf"), dkim.alias("dkim"), dmarc.alias("dmarc")), judged)
