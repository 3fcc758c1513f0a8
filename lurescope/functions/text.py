"""Column functions over text, links and addresses; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurescope.plans import knowledge as K

#: Second-level labels under which country registries sell names, and public suffixes of two labels.
REGISTRY_SECOND_LEVEL = ("com", "net", "org", "edu", "gov", "co", "ac", "or", "ne", "go", "gob", "gouv", "mil", "nom", "sch", "ltd", "plc")
MULTI_TLDS = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "sch.uk", "nhs.uk", "co.in", "net.in", "org.in", "gov.in", "ac.in", "edu.in", "com.au",
    "net.au", "org.au", "gov.au", "edu.au", "co.nz", "co.za", "com.br", "gov.br", "org.br", "net.br", "com.mx", "com.sg", "com.hk", "co.jp", "com.tr",
    "com.cn", "com.tw", "co.kr", "com.my", "co.id", "com.ph",
)
#: Characters of a link at most; closing brackets that are taken off a link's end at most.
URL_CHARS, BRACKETS = 8192, 16

URL = r"""(?i)(?:(?:https?|ftp)://|www\.)[^\s<>"'`\\\u00a0\x00-\x1f\x7f]{1,8192}"""
EMAIL = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PHONE = r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: expressions that use one several times would repeat its whole tree."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def refang(text: Column) -> Column:
    """Undoes the usual ways of writing links so that they can't be clicked; in this order."""
    rules = (
        (r"(?i)h(?:xx|\*\*)p(s?)\s*(?::|\[:\])//", "http$1://"),
        (r"\[\s*\.\s*\]|\(\s*\.\s*\)|\{\s*\.\s*\}|\\\.", "."),
        (r"\[\s*:\s*\]|\(\s*:\s*\)", ":"),
        (r"(?i)\[\s*dot\s*\]|\(\s*dot\s*\)", "."),
        (r"(?i)\[\s*at\s*\]|\(\s*at\s*\)", "@"),
        (r"\[\s*/\s*\]", "/"),
    )
    for pattern, plain in rules:
        text = F.regexp_replace(text, pattern, plain)
    return text


def defang_host(host: Column) -> Column:
    return F.replace(host, F.lit("."), F.lit("[.]"))


def raw_host(url: Column) -> Column:
    """Lower-cased host without user, port and final dot, as written; empty if there is none."""
    authority = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1), r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"\.$", ""))


def host_of(url: Column) -> Column:
    """raw_host with an address in any spelling as dotted quad."""
    return canonical_host(raw_host(url))


def canonical_host(host: Column) -> Column:
    return let(F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"\.+$", ""), lambda bare: F.coalesce(ipv4(bare), bare))


def is_ip(host: Column) -> Column:
    """Four numbers with dots, or hexadecimal groups with colons."""
    return host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$") | (host.rlike(r"^\[?[0-9a-fA-F:.]*:[0-9a-fA-F:.]*:[0-9a-fA-F:.]*\]?$"))


def defang_url(url: Column) -> Column:
    """Only the authority is changed, so that the path stays readable."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.regexp_replace(scheme, "(?i)^http", "hxxp"), F.lit("://"), defang_host(authority), rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def registrable_domain(host: Column) -> Column:
    """An address itself; two labels, or three under a known suffix of two or a country's second-level registry."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    registry = F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.try_element_at(labels, F.lit(-2)).isin(*REGISTRY_SECOND_LEVEL)
    return F.when(host.rlike(r"^[0-9.]+$|:") | (n < 3), host).when(registry | last(2).isin(*MULTI_TLDS), last(3)).otherwise(last(2))


def domain_label(host: Column) -> Column:
    return F.substring_index(registrable_domain(host), ".", 1)


def tld(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def on_the_internet(host: Column) -> Column:
    return ~F.lower(tld(F.regexp_replace(host, r"\.+$", ""))).isin(*K.PRIVATE_TLDS)


def domain_of_address(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", -1))


def ipv4(host: Column) -> Column:
    """Dotted quad of an address as browsers read it: one to four numbers, each decimal, octal (0..) or hexadecimal (0x..).

    The last number fills the bytes that are left. Null for all else.
    """
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")

    def number(p: Column) -> Column:
        digits = F.when(F.length(p) == 2, F.lit("0")).otherwise(F.substring(p, 3, 64))
        found = F.when(p.rlike("^0[xX][0-9a-fA-F]*$"), F.conv(digits, 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).when(p.rlike("^(0|[1-9][0-9]*)$"), p)
        return F.when(F.length(found) <= 10, found.cast("long"))

    def whole(values: Column) -> Column:
        n = F.size(values)
        head, tail, room = F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.element_at(values, -1), F.pow(F.lit(256), 5 - n)
        fits = n.between(1, 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(head, lambda v: v <= 255) & (tail < room)
        return F.when(fits, F.aggregate(head, F.lit(0).cast("long"), lambda total, v: total * 256 + v) * room.cast("long") + tail)

    def dotted(total: Column) -> Column:
        return F.when(total.isNotNull(), F.concat_ws(".", *[F.shiftrightunsigned(total, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]))

    return F.when((F.length(host) <= 64) & host.rlike("^[0-9]"), let(let(F.transform(parts, number), whole), dotted))


def clean_url(raw: Column) -> Column:
    """A link as a browser reads it: no tabs or line breaks, no punctuation or unmatched brackets at its end, a scheme before www."""
    url = F.regexp_replace(F.substring(raw, 1, 2 * URL_CHARS), r"[\t\n\r]", "")
    url = F.substring(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), 1, URL_CHARS)
    url = F.regexp_replace(url, "^[\\u200b\\u200c\\ufeff]+|[\\u200b\\u200c\\ufeff]+$", "")
    url = F.regexp_replace(url, r"""[.,;:!?"'*_]+$""", "")
    count = lambda u, c: F.length(u) - F.length(F.replace(u, F.lit(c)))

    def cut(u: Column, _) -> Column:
        loose = [F.endswith(u, F.lit(close)) & (count(u, opened) < count(u, close)) for opened, close in ("()", "[]", "{}")]
        return F.when(loose[0] | loose[1] | loose[2], F.left(u, F.length(u) - 1)).otherwise(u)

    url = F.aggregate(F.sequence(F.lit(1), F.lit(BRACKETS)), url, cut)
    return F.regexp_replace(url, r"^(?i)(?=www\.)", "http://")


def usable_url(url: Column) -> Column:
    """http, https or ftp with a host that has a dot, is localhost or an address."""
    good = let(host_of(url), lambda host: F.contains(host, F.lit(".")) | (host == "localhost") | is_ip(host))
    return url.rlike("(?i)^(https?|ftp)://") & good


def urls_from_text(text: Column) -> Column:
    """The links of a text, in order, defanged ones too."""
    found = F.regexp_extract_all(refang(F.coalesce(text, F.lit(""))), F.lit(URL), F.lit(0))
    return F.filter(F.transform(found, clean_url), usable_url)


def defang_text(text: Column) -> Column:
    """The text with every link in it defanged, the longest first where one begins another."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"""(?i)(?:https?|ftp)://[^\s"'<>]{1,2000}"""), F.lit(0)))
    longest = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda t, u: F.replace(t, u, defang_url(u)))


def query_value(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded; empty if there is none."""
    found = F.regexp_extract(query_of(url), rf"(?:^|&){name}=([^&]*)", 1)
    return F.coalesce(F.try_url_decode(found), found)


def unwrap_link(url: Column) -> Column:
    """(inner, who, kind) of a link that a gateway rewrote or a redirector hides, else null."""
    parts = F.struct(url.alias("url"), raw_host(url).alias("host"), path_of(url).alias("path"))
    return let(let(parts, _wrapped), lambda out: F.when(usable_url(out["inner"]) & (out["inner"] != out["url"]), out))


def _wrapped(parts: Column) -> Column:
    """url, inner, who, kind of a wrapped link, else null; inner may be no link."""
    url, host, path = parts["url"], parts["host"], parts["path"]
    on = lambda domain: (host == domain) | host.endswith(f".{domain}")
    google = host.rlike(r"(^|\.)google\.[a-z]{2,3}(\.[a-z]{2})?$")
    value = lambda name: query_value(url, name)
    encoded = F.translate(F.regexp_extract(query_of(url), r"(?:^|&)u=([^&]*)", 1), "-_", "%/")
    token = F.regexp_extract(query_of(url), r"(?:^|&)u=a1([^&]*)", 1)
    padded = F.rpad(F.translate(token, "-_", "+/"), F.ceil(F.length(token) / 4).cast("int") * 4, F.lit("="))
    after = F.regexp_replace(path, r"^/amp/(s/)?", "")
    amp = F.concat(F.when(path.startswith("/amp/s/"), F.lit("https://")).otherwise(F.lit("http://")), after, F.when(query_of(url) != "", F.concat(F.lit("?"), query_of(url))).otherwise(F.lit("")))
    rules = (
        (on("safelinks.protection.outlook.com"), value("url"), "Microsoft Safe Links", "gateway"),
        ((host == "urldefense.proofpoint.com") & path.startswith("/v2/url"), F.coalesce(F.try_url_decode(encoded), encoded), "Proofpoint URL Defense", "gateway"),
        (host == "urldefense.com", F.regexp_extract(url, r"(?i)urldefense\.com/v3/__(.+?)__;", 1), "Proofpoint URL Defense", "gateway"),
        (host == "linkprotect.cudasvc.com", value("a"), "Barracuda Link Protection", "gateway"),
        (google & (path == "/url"), F.coalesce(F.nullif(value("q"), F.lit("")), value("url")), "Google redirect", "redirect"),
        (google & path.startswith("/amp/"), amp, "Google AMP", "redirect"),
        (on("bing.com") & (path == "/ck/a"), F.coalesce(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), F.lit("")), "Bing redirect", "redirect"),
        (host.isin("l.facebook.com", "lm.facebook.com") | (on("facebook.com") & (path == "/l.php")), value("u"), "Facebook redirect", "redirect"),
        (on("youtube.com") & (path == "/redirect"), value("q"), "YouTube redirect", "redirect"),
        (on("linkedin.com") & path.startswith("/redir/redirect"), value("url"), "LinkedIn redirect", "redirect"),
    )
    out = None
    for test, inner, who, kind in rules:
        made = F.struct(inner.alias("inner"), F.lit(who).alias("who"), F.lit(kind).alias("kind"))
        out = F.when(test, made) if out is None else out.when(test, made)
    return let(out, lambda o: F.when(o.isNotNull(), F.struct(url.alias("url"), clean_url(o["inner"]).alias("inner"), o["who"].alias("who"), o["kind"].alias("kind"))))


_BUCKET = (
    r"(?:^|\.)objectstorage\.[a-z0-9-]+\.(?:oraclecloud\.com|oci\.customer-oci\.com)$|\.(?:digitaloceanspaces|backblazeb2|wasabisys|linodeobjects)\.com$"
    r"|\.cloud-object-storage\.appdomain\.cloud$|\.oss-[a-z0-9-]+\.aliyuncs\.com$|\.storage\.googleapis\.com$|\.blob\.core\.windows\.net$"
    r"|(?:^|\.)s3[.-](?:[a-z0-9-]+\.)?amazonaws\.com$|\.s3\.dualstack\.[a-z0-9-]+\.amazonaws\.com$"
)


def _ends(host: Column, ends: tuple[str, ...]) -> Column:
    return host.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in ends) + ")$")


def _stored(host: Column, path: Column) -> Column:
    return host.endswith(".supabase.co") & path.startswith("/storage/v1/object/")


def hosting_kind(url: Column) -> Column:
    """tunnel or IPFS, free hosting, file sharing, or empty."""
    path = F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/"))
    return let(F.struct(raw_host(url).alias("host"), path.alias("path")), lambda p: _kind_of(p["host"], p["path"]))


def _kind_of(host: Column, path: Column) -> Column:
    bare = F.regexp_replace(host, r"^www\.", "")
    shared = _stored(host, path)
    for name, prefixes in K.FILE_SHARING:
        shared = shared | ((bare == name) & path.rlike("^(?:" + "|".join(prefixes) + ")"))
    tunnel = _ends(host, K.TUNNELS) | (host.isin(*K.IPFS_GATEWAYS) & path.startswith("/ipfs/"))
    free = _ends(host, K.FREE_HOSTING) | host.rlike(_BUCKET)
    return F.when(tunnel, F.lit("tunnel or IPFS")).when(free, F.lit("free hosting")).when(shared, F.lit("file sharing")).otherwise(F.lit(""))


def stored_web_page(url: Column) -> Column:
    """Whether a link opens a page kept as a file in a storage bucket."""
    host, path = raw_host(url), path_of(url)
    bucket = host.rlike(_BUCKET) | host.isin("storage.googleapis.com", "firebasestorage.googleapis.com") | _stored(host, path)
    return bucket & F.lower(F.regexp_replace(path, "/+$", "")).rlike(r"\.(?:html|htm|shtml|xhtml|svg)$")


def mixed_scripts(text: Column) -> Column:
    """Whether a word has Latin letters and letters that look like them."""
    other = r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}]"
    return text.rlike(rf"\p{{IsLatin}}[\p{{L}}\p{{M}}]*{other}|{other}[\p{{L}}\p{{M}}]*\p{{IsLatin}}")


def report_id(sha256: Column) -> Column:
    return F.concat(F.lit("PH-"), F.upper(F.left(sha256, F.lit(16))))


def name_fold(name: Column) -> Column:
    """Digit runs to ``#``, lower case, single spaces; empty under 4 characters."""
    folded = F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, r"\d+", "#"), r"\s+", " ")))
    return F.when(F.length(folded) >= 4, folded).otherwise(F.lit(""))


def subject_fold(subject: Column) -> Column:
    """Reply and forward prefixes dropped, digit runs to ``#``, lower case; empty under 8 characters."""
    bare = F.regexp_replace(subject, r"(?i)^(\s*(re|fwd?|aw|wg)\s*:\s*)+", "")
    folded = F.lower(F.trim(F.regexp_replace(F.regexp_replace(bare, r"\d+", "#"), r"\s+", " ")))
    return F.when(F.length(folded) >= 8, folded).otherwise(F.lit(""))


def csv_safe(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def signal_kind(label: Column) -> Column:
    """What labels of one kind share: without what is in parentheses and quotes, names as D, digits as N, up to a colon."""
    for pattern, plain in ((r"\([^)]*\)", "()"), ("'[^']*'", "''"), (r"\S+\[\.\]\S+", "D"), (r"\d+", "N")):
        label = F.regexp_replace(label, pattern, plain)
    return F.regexp_replace(label, "(?s)^([^:]*:).*$", "$1")
