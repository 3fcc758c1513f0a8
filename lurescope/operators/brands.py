"""Domains and names that pass for somebody else's: lookalike domains, and brands that a sender claims.

Brands and the words that fill up their names are inputs: a table (brand, ord, domains, token_only) and a list. Domains are
compared once each, whatever the number of messages that have them, in Arrow batches, as no built-in function folds
letters that look alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.functions import text as T
from lurescope.plans import knowledge as K
from lurescope.runtime import ship

#: Brands that a dimension has at most, as every worker gets all of them.
BRANDS = 5_000
#: Characters that are read as another one, and pairs that are read as one character.
READ_AS = {
    "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l", "!": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ӏ": "l", "ԁ": "d", "ѕ": "s", "һ": "h", "ԛ": "q", "ԝ": "w",
    "ɡ": "g", "ո": "n", "ս": "u", "ı": "i", "ł": "l", "ø": "o", "ð": "d", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "τ": "t", "ι": "i", "κ": "k",
}
PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"))
#: Country domains that are sold to anyone.
GENERIC_CCTLDS = ("co", "cc", "tk", "ml", "ga", "cf", "gq", "ws", "io", "me", "ly", "to", "su", "pw", "cm", "nu", "tv", "ai", "sh", "gg", "la", "vc", "st", "cx", "ms", "fm", "am", "ru")
#: Words that make a brand in a subject a notice about an account.
ACCOUNT_CONTEXT = (
    "account", "sign-in", "signin", "login", "password", "verify", "verification", "security", "suspend", "suspended", "locked", "unusual", "payment",
    "invoice", "billing", "subscription", "renew", "renewal", "refund", "delivery", "package", "parcel", "shipment", "wallet", "tokens", "reward",
    "prize", "storage", "mailbox", "document", "shared", "voicemail", "order", "conta", "cuenta", "konto", "compte", "alert", "notice", "confirm", "update",
)


def plain(label: str) -> str:
    """A label in lower case with punycode undone."""
    if "xn--" in label:
        try:
            label = label.encode("ascii").decode("idna")
        except UnicodeError:
            pass
    return label.lower()


def readings(label: str) -> set[str]:
    """What a reader may take a label for."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", plain(label)) if not unicodedata.combining(c))
    whole = {"".join(READ_AS.get(c, c) for c in text) for text in (bare, bare.replace("1", "i"))}
    return whole | {text.replace(two, one) for text in whole for two, one in PAIRS}


def distance(a: str, b: str) -> int:
    """Edits between two words, where swapping neighbours is one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@dataclass(frozen=True)
class Comparison:
    """One label against names; ``filler`` matches text that is made of known words alone."""

    label: str
    suffix: str
    filler: re.Pattern

    def filled(self, text: str, name: str) -> bool:
        """Whether text is the name and nothing but known words, digits and codes of up to two letters."""
        before, found, after = text.partition(name)
        return bool(found) and all(len(p) <= 2 or self.filler.fullmatch(p) for side in (before, after) for p in re.findall("[a-z]+", side))

    def protected(self, name: str) -> str:
        """The method by which the label passes for an organisation's own name, empty if it doesn't."""
        seen, near = readings(self.label), 1 if len(name) < 8 else 2
        tests = (
            ("tld-swap", self.label == name),
            ("typosquat", self.label.replace("-", "") == name.replace("-", "")),
            ("homoglyph", name not in self.label and any(name in s for s in seen)),
            ("typosquat", any(abs(len(s) - len(name)) <= near and distance(s, name) <= near for s in seen)),
            ("combosquat", len(name) >= 5 and self.filled(self.label, name)),
        )
        return next((method for method, holds in tests if holds), "")

    def brand(self, name: str, token_only: bool) -> str:
        """The same for a brand; its own name on a country's domain is its own site."""
        if self.label == name:
            last = self.suffix.rpartition(".")[2]
            return "" if len(last) == 2 and last not in GENERIC_CCTLDS else "tld-swap"
        seen, parts = readings(self.label), lambda text: re.split("[-_.]", text)
        if token_only:
            if name in parts(self.label):
                return "combosquat" if self.filled(self.label, name) else ""
            return "homoglyph" if any(name in parts(s) for s in seen) else ""
        if name in self.label:
            return "combosquat" if self.filled(self.label, name) else ""
        joined = self.label.replace("-", "")
        near = (len(p) >= 5 and abs(len(p) - len(name)) <= 1 and distance(p, name) == 1 for s in seen for p in parts(s))
        tests = (
            ("typosquat", joined == name),
            ("combosquat", name in joined and self.filled(joined, name)),
            ("homoglyph", any(name in s for s in seen)),
            ("typosquat", len(name) >= 6 and any(near)),
        )
        return next((method for method, holds in tests if holds), "")

    def subdomain(self, host: str, name: str, token_only: bool) -> bool:
        """Whether a brand stands in a host's subdomain."""
        for part in filter(None, re.split("[-_.]", host)):
            for text in {part} | readings(part):
                if text == name or not token_only and name in text and self.filled(text, name):
                    return True
        return False


def _listed(brands: DataFrame) -> list[tuple[str, tuple[str, ...], bool]]:
    rows = brands.orderBy("ord").limit(BRANDS + 1).collect()
    if len(rows) > BRANDS:
        raise ValueError(f"more than {BRANDS} brands")
    return [(r.brand, tuple(r.domains), bool(r.token_only)) for r in rows]


def home(name: str, domains: tuple[str, ...]) -> str:
    """The domain that a brand is shown by."""
    ranked = sorted(domains, key=lambda d: (d != f"{name}.com", d.partition(".")[0] != name, name not in d, d))
    return ranked[0] if ranked else name


def lookalike_domains(hosts: DataFrame, brands: DataFrame, words: list[str], protected: tuple[str, ...] = ()) -> DataFrame:
    """host, target, method (tld-swap, typosquat, homoglyph, combosquat, subdomain) of each host that passes for a target. hosts: host.

    Hosts under a brand's or a protected domain pass for nothing. Each target is given once for a host, protected domains
    first. Addresses, null and empty hosts give nothing.
    """
    known = _listed(brands)
    filler = re.compile("(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + ")+")
    own = {d for _, domains, _ in known for d in domains} | set(protected)
    bare = F.regexp_replace(F.lower("host"), r"^\.+|\.+$", "")
    rows = hosts.select(bare.alias("host")).where("host <> ''").distinct()
    rows = rows.where(~T.is_ip(F.col("host"))).select("host", T.registrable_domain(F.col("host")).alias("base")).where(~F.col("base").isin(*sorted(own)) if own else F.lit(True))

    def found(host: str, base: str) -> Iterator[dict]:
        label, _, suffix = base.partition(".")
        one, seen = Comparison(plain(label), suffix, filler), set()
        under = host[: -len(base)].strip(".") if host != base else ""
        names = [(d, d.partition(".")[0]) for d in sorted(protected)]
        hits = [(domain, one.protected(name)) for domain, name in names if len(name) >= 4]
        hits += [(home(name, domains), one.brand(name, token_only)) for name, domains, token_only in known]
        hits += [(home(name, domains), "subdomain") for name, domains, token_only in known if under and one.subdomain(under, name, token_only)]
        for target, method in hits:
            if method and target not in seen:
                seen.add(target)
                yield {"host": host, "target": target, "method": method}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for one in batch.to_pylist() for r in found(one["host"], one["base"])]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string()) for n in ("host", "target", "method")]))

    ship(hosts.sparkSession)
    return rows.mapInArrow(run, "host string, target string, method string")


def _claimed(name: Column, known: Column) -> Column:
    """The first brand that stands in a name as a word or, if it has five letters, inside the name without spaces."""
    low = F.lower(F.coalesce(name, F.lit("")))
    words, joined = F.split(low, "[^a-z0-9]+"), F.regexp_replace(low, "[^a-z0-9]", "")
    return F.get(F.filter(known, lambda b: F.array_contains(words, b["brand"]) | (~b["token_only"] & (F.length(b["brand"]) >= 5) & F.contains(joined, b["brand"]))), F.lit(0))


def _owns(base: Column, brand: Column) -> Column:
    """Whether a domain is the brand's: a listed one, or its name on a country's domain that isn't much abused."""
    last = T.tld(base)
    country = (F.length(last) == 2) & ~last.isin(*GENERIC_CCTLDS) & ~last.isin(*K.SUSPICIOUS_TLDS)
    return F.array_contains(brand["domains"], base) | ((T.domain_label(base) == brand["brand"]) & country)


def brand_signals(messages: DataFrame, brands: DataFrame, key: str = "msg_id") -> DataFrame:
    """key, rule, severity, brand: claims of brands by display name (14, or 15 with look-alike characters), subject (20) and forwarded name (21).

    messages: key, display, subject, from_base, forwarded_display, forwarded_base, link_bases, urgent (whether a credential
    lure comes with a link). A claim is excused where the sender is the brand, and in subjects where a link is.
    """
    known = _listed(brands)
    listed = F.array(*[F.struct(F.lit(b).alias("brand"), F.array(*map(F.lit, d)).alias("domains"), F.lit(t).alias("token_only")) for b, d, t in known])
    read = F.translate(F.lower("display"), "".join(READ_AS), "".join(READ_AS.values()))
    rows = messages.withColumns({"name_brand": _claimed(F.col("display"), listed), "read_brand": _claimed(read, listed), "subject_brand": _claimed(F.col("subject"), listed), "forward_brand": _claimed(F.col("forwarded_display"), listed)})
    foreign = lambda brand, base: F.col(brand).isNotNull() & ~F.coalesce(_owns(F.coalesce(F.col(base), F.lit("")), F.col(brand)), F.lit(False))
    notice = F.arrays_overlap(F.split(F.lower("subject"), "[^a-z0-9-]+"), F.array(*map(F.lit, ACCOUNT_CONTEXT)))
    linked = F.exists(F.coalesce("link_bases", F.array().cast("array<string>")), lambda base: _owns(base, F.col("subject_brand")))
    same = F.coalesce(F.col("name_brand.brand") == F.col("subject_brand.brand"), F.lit(False))
    made = lambda test, rule, level, brand: F.when(test, F.struct(F.lit(rule).alias("rule"), level.alias("severity"), F.col(f"{brand}.brand").alias("brand")))
    high = F.lit("high")
    found = F.array_compact(
        F.array(
            made(foreign("name_brand", "from_base"), 14, high, "name_brand"),
            made(F.col("name_brand").isNull() & foreign("read_brand", "from_base"), 15, high, "read_brand"),
            made(foreign("subject_brand", "from_base") & notice & ~linked & ~same, 20, F.when(F.col("urgent"), "high").otherwise("medium"), "subject_brand"),
            made(foreign("forward_brand", "forwarded_base"), 21, high, "forward_brand"),
        )
    )
    return rows.select(key, F.explode(found).alias("s")).select(key, "s.*")


def disguised_words(messages: DataFrame, brands: DataFrame, key: str = "msg_id") -> DataFrame:
    """key, rule (8), severity, brand, place, word: the first word of a subject and of a display name that spells a brand with a
    capital I for l, digits for letters, or both. messages: key, subject, display, from_base; senders at a brand's domain are excused.
    """
    known = _listed(brands)
    long = [b for b, _, _ in known if len(b) >= 5]
    own = sorted({d for _, domains, _ in known for d in domains})
    digits = {k: v for k, v in READ_AS.items() if k.isdigit() and k != "9"}
    bare = lambda w: F.lower(F.translate(w, "I", "l"))
    lettered = lambda w: F.translate(w, "".join(digits), "".join(digits.values()))

    def spelt(word: Column) -> Column:
        low = F.lower(word)
        read = F.filter(F.array(bare(word), lettered(low), lettered(bare(word))), lambda c: (c != low) & c.isin(*long))
        return F.when(~low.isin(*[b for b, _, _ in known]), F.struct(F.get(read, F.lit(0)).alias("brand"), word.alias("word")))

    def first(place: str, column: str) -> Column:
        words = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"([A-Za-z0-9]{4,24})"), F.lit(1))
        hit = F.get(F.filter(F.transform(words, spelt), lambda s: s["brand"].isNotNull()), F.lit(0))
        return F.when(hit.isNotNull(), F.struct(hit["brand"].alias("brand"), F.lit(place).alias("place"), hit["word"].alias("word")))

    rows = messages if not own else messages.where(~F.coalesce(F.col("from_base"), F.lit("")).isin(*own))
    rows = rows.select(key, F.explode(F.array_compact(F.array(first("subject", "subject"), first("display name", "display")))).alias("s"))
    return rows.select(key, F.lit(8).alias("rule"), F.lit("high").alias("severity"), "s.*")


def strong_subdomain(host: Column, target: Column) -> Column:
    """Whether a brand's name left of a domain is no coincidence: its whole domain, or an abused domain, free hosting or a credential word."""
    base = T.registrable_domain(host)
    label = T.domain_label(base)
    long, short = (f"{'|'.join(w for w in K.CREDENTIAL_WORDS if (len(w) >= 5) == whole)}" for whole in (True, False))
    worded = label.rlike(f"{long}|(?<![a-z0-9])(?:{short})(?![a-z0-9])")
    return F.contains(F.left(host, F.length(host) - F.length(base)), target) | T.tld(base).isin(*K.SUSPICIOUS_TLDS) | (T.hosting_kind(F.concat(F.lit("https://"), host, F.lit("/"))) != "") | worded


#: Where a message names a host, in the order in which a lookalike is reported.
PLACES = ("sender", "reply-to", "return-path", "url")


def lookalike_signals(named: DataFrame, brands: DataFrame, words: list[str], protected: tuple[str, ...] = (), allowed: tuple[str, ...] = ()) -> DataFrame:
    """msg_id, rule (23), severity, family, place, host, target, method: lookalikes among the hosts that messages name.

    named: msg_id, host, place (of ``PLACES``). A target is reported once for a domain of a message, at its first place and
    least host. Each distinct host is judged once, however many messages name it; ``allowed`` domains never are.
    """
    bare = F.regexp_replace(F.lower("host"), r"^\.+|\.+$", "")
    rank = F.array_position(F.array(*map(F.lit, PLACES)), F.col("place"))
    rows = named.select("msg_id", bare.alias("host"), rank.alias("rank")).where("host <> ''").groupBy("msg_id", "host").agg(F.min("rank").alias("rank"))
    rows = rows.withColumn("base", T.registrable_domain(F.col("host")))
    rows = rows.where(~F.col("base").isin(*allowed)) if allowed else rows
    found = rows.join(lookalike_domains(rows.select("host"), brands, words, protected), "host")
    best = F.min(F.struct("rank", "host", "method"))
    found = found.groupBy("msg_id", "base", "target").agg(best.alias("b")).select("msg_id", "base", "target", "b.*")
    own = F.col("target").isin(*protected) if protected else F.lit(False)
    word_only = [name for name, _, token_only in _listed(brands) if token_only]
    ordinary = (T.domain_label(F.col("target")).isin(*word_only) if word_only else F.lit(False)) & ~own & ~T.tld(F.col("base")).isin(*K.SUSPICIOUS_TLDS)
    level = (
        F.when(F.col("method") == "tld-swap", F.when(ordinary, "low").otherwise("medium"))
        .when(F.col("method") == "subdomain", F.when(strong_subdomain(F.col("host"), F.col("target")), "high").otherwise("low"))
        .when(F.col("method").isin("homoglyph", "typosquat") | own, "high").otherwise("medium")
    )
    place = F.element_at(F.array(*map(F.lit, PLACES)), F.col("rank").cast("int"))
    return found.select("msg_id", F.lit(23).alias("rule"), level.alias("severity"), F.when(place == "url", "link").otherwise("sender").alias("family"), place.alias("place"), "host", "target", "method")


def read_suffixes(lines: DataFrame) -> DataFrame:
    """suffix, kind (rule, wildcard, exception) of a public suffix list's lines. lines: value."""
    bare = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    rows = lines.select(bare.alias("s")).where("s <> '' AND s NOT LIKE '//%'")
    kind = F.when(F.col("s").startswith("!"), "exception").when(F.col("s").startswith("*."), "wildcard").otherwise("rule")
    return rows.select(F.regexp_replace("s", r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind"))


def by_public_suffix(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """host, domain: one label more than the public suffix; an exception wins, then the longest rule, else the last label. hosts: host.

    A host's ends are joined with the list by equality, so that no host is compared with all rules.
    """
    rows = hosts.select("host").distinct().withColumn("labels", F.split("host", r"\.")).withColumn("n", F.size("labels"))
    ends = rows.select("host", "labels", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    ends = ends.withColumn("suffix", F.array_join(F.slice("labels", F.col("n") - F.col("k") + 1, F.col("k")), "."))
    hit = ends.join(suffixes, "suffix")
    # How many labels the public suffix has.
    size = F.when(F.col("kind") == "exception", F.col("k") - 1).when(F.col("kind") == "wildcard", F.col("k") + 1).otherwise(F.col("k"))
    best = hit.groupBy("host").agg(F.max(F.struct((F.col("kind") == "exception").alias("wins"), size.alias("size"))).alias("best"))
    joined = rows.join(best, "host", "left").withColumn("take", F.least(F.coalesce("best.size", F.lit(1)) + 1, F.col("n")))
    return joined.select("host", F.array_join(F.slice("labels", F.col("n") - F.col("take") + 1, F.col("take")), ".").alias("domain"))


def sweep(mailbox: DataFrame, senders: DataFrame, domains: DataFrame, subjects: DataFrame) -> DataFrame:
    """id, matched (labels in order) of the copies that mailboxes hold. mailbox: id, sender, subject; senders, domains, subjects: value, small tables.

    A sender matches whole, a domain itself and below it, and a folded subject where the mail's contains it.
    """
    rows = mailbox.select("id", F.lower("sender").alias("sender"), T.domain_of_address(F.col("sender")).alias("host"), T.subject_fold(F.col("subject")).alias("folded"))
    by_sender = rows.join(senders.select(F.lower("value").alias("sender")), "sender", "left_semi").select("id", F.lit("sender").alias("label"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    by_domain = rows.select("id", F.explode(ends).alias("value")).join(domains.select(F.lower("value").alias("value")), "value", "left_semi").select("id", F.lit("domain").alias("label"))
    wanted = [r.folded for r in subjects.select(T.subject_fold(F.col("value")).alias("folded")).where("folded <> ''").limit(1000).collect()]
    inside = F.lit(False)
    for subject in wanted:
        inside = inside | F.contains(F.col("folded"), F.lit(subject))
    by_subject = rows.where(inside).select("id", F.lit("subject").alias("label"))
    found = by_sender.unionByName(by_domain).unionByName(by_subject)
    return found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("matched"))
