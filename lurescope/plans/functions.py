"""Column functions over every page: a page's number picks an input, and the expected value is written by hand beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.functions import auth as A
from lurescope.functions import text as T
from lurescope.functions import wallets as W
from lurescope.operators import links as L
from lurescope.runtime import table
from lurescope.sources import markup as M

_headers = lambda c: F.transform(F.split(c, "\n"), lambda line: F.struct(F.split_part(line, F.lit(": "), F.lit(1)).alias("name"), F.regexp_replace(line, "^[^:]*: ", "").alias("value")))
_auth = lambda c: A.authentication(_headers(c))
_row = lambda r: F.concat_ws(" ", r["result"], r["domain"], F.coalesce(r["aligned"].cast("string"), F.lit("-")))


def _aligned(c: Column) -> Column:
    return T.let(A.alignment(_auth(c), F.lit("news.shop.example"), F.lit("bounce.mailer.net")), lambda a: F.concat_ws("; ", a["status"], _row(a["spf"]), _row(a["dkim"]), a["dmarc"]["result"]))


_AR = "Authentication-Results: "
#: The receiver's two headers, another header, then claims in its name and in that of another server.
_FORGED = f"Received: by mx\n{_AR}mx.our.example; spf=fail smtp.mailfrom=evil.example\n{_AR}mx.our.example; dkim=none\nSubject: x\n{_AR}MX.our.example; spf=pass; dkim=PASS\n{_AR}relay.example; dmarc=pass"
#: A comment names another domain; the bulk mailer's own pass isn't aligned, the second signature is.
_BULK = f"{_AR}mx.our.example; spf=pass (domain of a@other.example (x)) smtp.mailfrom=\"b@mailer.net\"; dkim=pass header.d=mailer.net; dkim=pass header.i=@shop.example"
_SPF_NEAR = "Received-SPF: SoftFail; (x) envelope-from=\"u@Shop.example.\"; client-ip=1\nTo: a"
_SPF_FAR = f"{_AR}mx; dkim=fail\nA: 1\nB: 2\nC: 3\nReceived-SPF: pass domain of u@shop.example designates 1"

#: Markup that hides text by an attribute, a style, a class rule and a box of no size; only the third part is a word's.
_HIDING = "<style>.pre{font-size:0px}</style><p>Pay<span class=Pre>x1</span>Pal <b hidden>deep</b> note</p><div style='max-height:0; overflow: hidden'>low</div>end"
_LINKED = "<a href=' https://a.net/q '>Go <b>now</b></a><a>none</a><img src=p.png background=b.png><form action=/in method=POST><input type=PASSWORD></form><meta http-equiv=Refresh content='5; URL=http://m.net/'><script>top.location.href = 'http://s.net/1'; location.assign(\"http://s.net/2\")</script>"
_WORDS = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60))
_WRAPPED = "https://na01.safelinks.protection.outlook.com/?url=https%3A%2F%2Fwww.google.com%2Furl%3Fq%3Dhttps%253A%252F%252Fa.net%252Fx"
_seen = lambda c: M.read_markup(c)
_layers = lambda c: F.array_join(F.transform(L.unwrapped(F.struct(F.lit("body-text").alias("source"), c.alias("url"), F.lit("t").alias("shown"))), lambda k: F.concat_ws("|", *[k[n] for n in ("source", "url", "shown", "redirect_to")])), " ")
_raw = lambda c: F.array_join(F.transform(L.raw_links(F.lit("see www.z.org"), _seen(c)), lambda k: F.concat_ws(" ", k["source"], k["url"], k["shown"])), "; ")

#: Name: (function, pairs of input and expected value). None is null.
CASES: dict[str, tuple[Callable[[Column], Column], list[tuple[str | None, object]]]] = {
    "fn_refang": (T.refang, [("h**ps://a{.}net/x", "https://a.net/x"), ("HXXP[:]//b(.)org", "http://b.org"), ("me ( AT ) c[ dot ]com", "me @ c.com"), ("d\\.com[/]p", "d.com/p"), ("plain text", "plain text")]),
    "fn_defang_text": (T.defang_text, [("go to http://a.net/x.y now", "go to hxxp://a[.]net/x.y now"), ("none", "none"), ("http://a.net http://a.net/b", "hxxp://a[.]net hxxp://a[.]net/b")]),
    "fn_ipv4": (T.ipv4, [("2130706433", "127.0.0.1"), ("0x7f.1", "127.0.0.1"), ("0177.0.0.01", "127.0.0.1"), ("10.0.258", "10.0.1.2"), ("8.8.8.8.", "8.8.8.8"), ("8.8.8.300", None), ("08.1.1.1", None), ("4294967296", None), ("a.b", None)]),
    "fn_canonical_host": (T.canonical_host, [("WWW.A.Net..", "www.a.net"), ("0x08080808", "8.8.8.8"), (None, "")]),
    "fn_is_ip": (T.is_ip, [("8.8.8.8", True), ("2001:db8::1", True), ("a.net", False)]),
    "fn_registrable_domain": (T.registrable_domain, [("x.y.gouv.fr", "y.gouv.fr"), ("a.b.nhs.uk", "b.nhs.uk"), ("p.q.co.com", "co.com"), ("s.t.com.ar", "t.com.ar"), ("a.net", "a.net"), ("8.8.8.8", "8.8.8.8")]),
    "fn_domain_label": (T.domain_label, [("x.shop.co.uk", "shop"), ("mail.a.net", "a")]),
    "fn_domain_of_address": (T.domain_of_address, [("A@B@C.Net", "c.net"), ("none", "none")]),
    "fn_on_the_internet": (T.on_the_internet, [("a.net", True), ("printer.lan.", False), ("x.Test", False)]),
    "fn_clean_url": (T.clean_url, [("www.a.net/p).", "http://www.a.net/p"), ("http://a.net/(p)", "http://a.net/(p)"), (" http://a.\tnet/x!? ", "http://a.net/x"), ("http://a.net/[x]]]", "http://a.net/[x]")]),
    "fn_usable_url": (T.usable_url, [("https://a.net/", True), ("ftp://localhost/x", True), ("https://intranet/", False), ("mailto:a@b.net", False), ("http://134744072/", True)]),
    "fn_first_url": (lambda c: T.urls_from_text(c)[0], [("see hxxps://a[.]net/p, ok", "https://a.net/p"), ("(www.b.org)", "http://www.b.org")]),
    "fn_url_count": (lambda c: F.size(T.urls_from_text(c)).cast("long"), [("http://a.net http://b http://c.org/x", 2), ("no links", 0), (None, 0)]),
    "fn_unwrap_inner": (lambda c: T.unwrap_link(c)["inner"], [("https://na01.safelinks.protection.outlook.com/?url=https%3A%2F%2Fa.net%2Fq&x=1", "https://a.net/q"), ("https://urldefense.proofpoint.com/v2/url?u=http-3A__a.net_q&d=1", "http://a.net/q"), ("https://urldefense.com/v3/__http://a.net/q__;!!z", "http://a.net/q"), ("https://linkprotect.cudasvc.com/url?a=https%3a%2f%2fa.net&c=1", "https://a.net"), ("https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9hLm5ldC9x", "https://a.net/q"), ("https://notbing.com/ck/a?u=a1aHR0cHM6Ly9hLm5ldC9x", None), ("https://www.youtube.com/redirect?q=https://a.net/", "https://a.net/"), ("https://a.net/", None)]),
    "fn_unwrap_kind": (lambda c: T.unwrap_link(c)["kind"], [("https://www.google.de/url?q=https://a.net/", "redirect"), ("https://www.google.com/amp/s/a.net/p", "redirect"), ("https://linkprotect.cudasvc.com/url?a=https://a.net", "gateway"), ("https://google.evil.net/url?q=https://a.net/", None)]),
    "fn_hosting_kind": (T.hosting_kind, [("https://t.trycloudflare.com/", "tunnel or IPFS"), ("https://dweb.link/ipfs/Q", "tunnel or IPFS"), ("https://dweb.link/x", ""), ("https://me.github.io/x", "free hosting"), ("https://b.blob.core.windows.net/x", "free hosting"), ("https://www.mediafire.com/file/1", "file sharing"), ("https://mediafire.com/about", ""), ("https://a.net/", "")]),
    "fn_stored_web_page": (T.stored_web_page, [("https://b.wasabisys.com/p.HTML/", True), ("https://b.wasabisys.com/p.pdf", False), ("https://a.net/p.html", False)]),
    "fn_mixed_scripts": (T.mixed_scripts, [("m\u0430il", True), ("mail \u0434\u043e\u043c", False), ("mail", False)]),
    "fn_signal_kind": (T.signal_kind, [("page on a[.]net", "page on D"), ("page on b[.]org", "page on D"), ("12 words (like this) in 'x': more: text", "N words () in '':"), ("No Change", "No Change")]),
    "fn_report_id": (T.report_id, [("0123456789abcdef0123", "PH-0123456789ABCDEF")]),
    "fn_name_fold": (T.name_fold, [("Team  42 Desk", "team # desk"), ("Al", "")]),
    "fn_auth_results": (lambda c: T.let(_auth(c), lambda a: F.concat_ws(",", *[F.coalesce(a[m], F.lit("-")) for m in A.MECHANISMS], a["header"], a["receiver"])), [(_FORGED, "fail,none,-,-,Authentication-Results,mx.our.example"), (_BULK, "pass,pass,-,-,Authentication-Results,mx.our.example"), (_SPF_NEAR, "softfail,-,-,-,Received-SPF,"), (_SPF_FAR, "-,fail,-,-,Authentication-Results,mx"), (f"{_AR}spf=none; compauth=fail", "none,-,-,fail,Authentication-Results,"), ("To: a", "-,-,-,-,,"), (None, "-,-,-,-,,")]),
    "fn_auth_forged": (lambda c: F.array_join(F.transform(_auth(c)["forged"], lambda f: F.concat_ws(" ", f["claim"], f["server"], f["impersonates"].cast("string"))), "; "), [(_FORGED, "spf=pass mx.our.example true; dkim=pass mx.our.example true; dmarc=pass relay.example false"), (_BULK, ""), ("To: a", "")]),
    "fn_auth_checks": (lambda c: F.array_join(F.transform(_auth(c)["checks"], lambda k: F.concat_ws(" ", k["method"], k["result"], k["domain"])), "; "), [(_FORGED, "spf fail evil.example; dkim none "), (_BULK, "spf pass mailer.net; dkim pass mailer.net; dkim pass shop.example"), (_SPF_NEAR, "spf softfail shop.example"), (_SPF_FAR, "dkim fail "), (f"{_AR}mx; dmarc=pass header.from=-bad-", "dmarc pass ")]),
    "fn_auth_trusted": (lambda c: F.coalesce(A.authentication(_headers(c), ("relay.example",))["dmarc"], F.lit("-")), [(_FORGED, "pass"), (_BULK, "-")]),
    "fn_alignment": (_aligned, [(_BULK, "pass; pass mailer.net false; pass shop.example true; none"), (_FORGED, "fail; fail evil.example false; none  -; none"), (_SPF_FAR, "fail; none bounce.mailer.net false; fail  -; none"), (f"{_AR}mx; dmarc=fail; spf=pass smtp.mailfrom=shop.example", "fail; pass shop.example true; none  -; fail"), ("To: a", "unknown; -; -")]),
    "fn_wallets": (lambda c: F.array_join(F.transform(W.wallets(c), lambda w: F.concat(w["currency"], F.lit(":"), F.substring(w["address"], 1, 6))), " "), [("to 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa or bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4.", "bitcoin:1A1zP1 bitcoin:bc1qw5"), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", ""), ("TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t (0xde0B295669a9FD93d5F28D9Ec85E40f4cb697BAe)", "tron:TR7NHq ethereum:0xde0B"), ("0x0000000000000000000000000000000000000000", ""), ("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0 twice bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", "bitcoin:bc1p0x"), ("4" + "A" * 94, "monero:4AAAAA"), (None, "")]),
    "fn_html_visible": (lambda c: _seen(c)["visible"], [(_HIDING, "PayPal note end"), ("a &amp; b<br>c<!-- no --><script>x</script>d", "a & b cd"), ("1 < 2 <b>3</b", "1 < 2 3</b"), ("", ""), (None, None)]),
    "fn_html_hidden": (lambda c: _seen(c)["hidden"], [(_HIDING, "x1 deep low"), ("<p style='opacity:0.4'>a</p><p style='opacity: 0'>b</p>", "b"), ("<br hidden>a<b hidden/>c", "")]),
    "fn_html_splits": (lambda c: F.concat_ws(",", *[_seen(c)[n].cast("string") for n in ("hidden_splits", "tag_splits")]), [(_HIDING, "1,0"), ("T<i></i>h<i></i>e<p>x</p>y", "0,2"), ("a<b hidden>,</b>b <b hidden>z</b> c", "0,1"), ("a<b hidden>z</b><i> </i>c", "1,0"), ("plain", "0,0")]),
    "fn_html_filler": (lambda c: _seen(c)["hidden_filler"].cast("long"), [(f"<p hidden>{_WORDS}</p>shown", 360), (f"<p hidden>{_WORDS}</p>{_WORDS}", 0), ("<p hidden>short</p>", 0)]),
    "fn_html_claim": (lambda c: _seen(c)["hidden_claim"], [("<i hidden>This is a  Safe Email, friend</i>x", "This is a Safe Email, friend"), ("<i hidden>harmless</i>harmless", ""), ("<i hidden>as an aid</i>", "")]),
    "fn_html_anchors": (lambda c: F.array_join(F.transform(_seen(c)["anchors"], lambda a: F.concat_ws(" ", a["href"], a["shown"])), "; "), [(_LINKED, "https://a.net/q Go now"), ("<A HREF=x>1<a href='y'>2</a>3", "x 1; y 23"), ("none", "")]),
    "fn_html_loads": (lambda c: F.array_join(F.concat(_seen(c)["resources"], _seen(c)["redirects"]), " "), [(_LINKED, "p.png b.png http://m.net/ http://s.net/1 http://s.net/2"), ("<iframe src>", "")]),
    "fn_html_forms": (lambda c: F.array_join(F.transform(_seen(c)["forms"], lambda f: F.concat_ws(" ", f["action"], f["method"], f["has_password"].cast("string"))), "; "), [(_LINKED, "/in post true"), ("<form></form><input type=password>", " get false")]),
    "fn_smuggling": (lambda c: F.array_join(M.smuggling(_seen(c)["scripts"]), ", "), [("<script>EVAL(atob('QQ'))</script>", "base64 decoding (atob), eval()"), ("<script>x='" + "A" * 800 + "'</script>", "large embedded base64 blob"), ("eval(", "")]),
    "fn_raw_links": (_raw, [("<a href='hxxp://a[.]net/'>x</a><a href='mailto:q@r.net'>m</a><img src='//c.net'> www.b.net.", "body-text http://www.z.org ; html-href http://a.net/ x; html-text http://www.b.net "), (None, "body-text http://www.z.org "), ("<form action='http://[::1]/'>", "body-text http://www.z.org ; html-form-action http://[::1]/ ")]),
    "fn_unwrap_layers": (_layers, [(_WRAPPED, "body-text via Microsoft Safe Links|https://www.google.com/url?q=https%3A%2F%2Fa.net%2Fx|t|https://a.net/x redirect target (Google redirect)|https://a.net/x||"), ("https://a.net/", "body-text|https://a.net/|t|")]),
    "fn_script_link": (lambda c: c.rlike(L.SCRIPTED), [("javascript:go()", True), ("JavaScript: void( 0 )", False), ("javascript:;", False), (" data: text/html,x", True), ("data:image/png,x", False)]),
    "fn_csv_safe": (T.csv_safe, [("=1+1", "'=1+1"), ("-x", "'-x"), ("x=1", "x=1")]),
}

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _literal(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (bool, int)) else "'" + str(value).replace("'", "''") + "'"


def _add(name: str, function: Callable[[Column], Column], cases: list[tuple[str | None, object]]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = F.array(*[F.lit(value).cast("string") for value, _ in cases])
        pages = table(spark, sf_dir, "pages").select("page_id", F.element_at(given, (F.col("page_id") % len(cases) + 1).cast("int")).alias("given"))
        return pages.select("page_id", function(F.col("given")).alias("value"))

    QUERIES[name] = query
    values = ", ".join(f"({i}, {_literal(value)})" for i, (_, value) in enumerate(cases))
    ORACLE_SQL[name] = f"SELECT page_id, value FROM pages JOIN (VALUES {values}) AS e(case_no, value) ON page_id % {len(cases)} = case_no"


for _name, (_function, _cases) in CASES.items():
    _add(_name, _function, _cases)


def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page's markup loads, links to and asks for."""
    pages = table(spark, sf_dir, "pages").select("page_id", M.read_markup(F.coalesce("html", F.lit(""))).alias("m"))
    return pages.select(
        "page_id", F.array_join(F.transform("m.anchors", lambda a: a["href"]), " ").alias("hrefs"), F.size("m.anchors").cast("long").alias("n_anchors"),
        F.array_join("m.resources", " ").alias("resources"), F.size("m.forms").cast("long").alias("n_forms"),
    )


QUERIES["page_markup"] = page_markup
ORACLE_SQL["page_markup"] = r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '(<(script|style)\b[^>]*>).*?</(script|style)\s*>', '\1', 'gsi') AS h FROM pages),
  t AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(h, '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''> ]*)', 1), lambda x: trim(x)), lambda x: x <> '') AS a, regexp_extract_all(h, '(?i)<[a-z][^>]*?\s(?:src|background|data-href|poster)\s*=\s*["'']?([^"''> ]*)', 1) AS r, len(regexp_extract_all(h, '(?i)<form\b')) AS n_forms FROM p)
  SELECT page_id, array_to_string(a, ' ') AS hrefs, len(a) AS n_anchors, array_to_string(r, ' ') AS resources, n_forms FROM t"""
