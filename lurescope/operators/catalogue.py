"""The rule catalogue: each rule is a condition over one row of facts, and gives a signal.

There are five grains of facts: messages, links, files, lookups and codes (QR). A table of a grain is gone through once:
all its rules are one array of conditional structs, which stays in generated code, and no rule is a join. Rules keep the
order of their numbers within a grain, so that the first of equal labels wins in ``scoring.dedupe``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.functions import text as T
from lurescope.plans import knowledge as K

_TEXT = "string", "''"
_FLAG = "boolean", "false"
_COUNT = "int", "0"
_LIST = "array<string>", "array()"

#: Columns of each grain's facts, with the value that a missing or null one has.
FACTS: dict[str, dict[str, tuple[str, str]]] = {
    "message": {
        **dict.fromkeys("from_domain from_base from_address reply_base display subject body spf dkim dmarc quoted_from quoted_domain hidden_claim phone forwarded_display forwarded_base".split(), _TEXT),
        **dict.fromkeys("mailing_list protected trusted auth_seen image too_deep".split(), _FLAG),
        **dict.fromkeys("mime_depth urls_dropped urls_checked zero_width hidden_splits tag_splits hidden_filler n_urls".split(), _COUNT),
        **dict.fromkeys("list_bases recipients forged_claims earlier_claims wallets credential crypto callback payment prize job qr extortion advance_fee delivery blocked lookalike_own".split(), _LIST),
    },
    "link": {**dict.fromkeys("url shown redirect_to wrapped_by".split(), _TEXT), **dict.fromkeys("trusted clicked flagged shown_known target_trusted decoded".split(), _FLAG)},
    "file": {
        **dict.fromkeys("filename true_type parent archive_kind password lnk_command redirect".split(), _TEXT),
        **dict.fromkeys("inline macro names_hidden encrypted risky_child scripts password_form decoded".split(), _FLAG),
        **dict.fromkeys("members unseen_risky calendar_links smuggling".split(), _COUNT),
        **dict.fromkeys("office pdf rtf lnk".split(), _LIST),
        **dict.fromkeys("organiser_base from_base".split(), _TEXT),
        "list_member": _FLAG,
    },
    "lookup": {**dict.fromkeys("kind value status".split(), _TEXT), **dict.fromkeys("malicious suspicious age score".split(), ("int", "cast(null as int)")), **dict.fromkeys("has_mx has_a named".split(), _FLAG)},
    "code": {**dict.fromkeys("payload place from_base dmarc".split(), _TEXT), **dict.fromkeys("lookalike lure".split(), _FLAG), "recipients": _LIST},
}


@dataclass(frozen=True)
class Rule:
    """severity is a level or a Spark SQL expression of one; label and test are expressions over the grain's facts."""

    number: int
    grain: str
    family: str
    severity: str
    techniques: str
    label: str
    test: str


def _in(name: str, values: tuple[str, ...]) -> str:
    return f"{name} IN ({', '.join(map(repr, values))})"


def _if(test: str, then: str = "high", other: str = "medium") -> str:
    return f"CASE WHEN {test} THEN '{then}' ELSE '{other}' END"


_HELD = "lower(regexp_extract(filename, '[.]([^.]+)$', 1))"
_FETCHED = "lower(regexp_extract(path, '[^/.][^/]*[.]([A-Za-z0-9]+)/*$', 1))"
_TLD = "substring_index(domain, '.', -1)"
_LONG = "|".join(w for w in K.CREDENTIAL_WORDS if len(w) > 4)
_SHORT = "|".join(w for w in K.CREDENTIAL_WORDS if len(w) <= 4)
_MONEY = "(CASE WHEN size(payment) > 0 THEN payment ELSE filter(prize, p -> contains(p, 'gift card')) END)"
_FREEMAIL = _in("from_base", K.FREEMAIL)
_ORGANISATION = "arrays_overlap(split(lower({0}), '[^a-z0-9]+'), array(" + ", ".join(map(repr, K.ORG_WORDS)) + "))"
_EMAIL = r"'(?i)[a-z0-9._%+-]+@[a-z0-9-]+(?:[.][a-z0-9-]+)+'"


def _auth(name: str, bad: tuple[str, ...]) -> Rule:
    return Rule(2, "message", "auth", _if(f"{name} = 'fail'"), "", f"concat('{name}=', {name})", _in(name, bad))


def _language(name: str, severe: bool) -> Rule:
    level = _if(f"size({name}) >= 2", "high" if severe else "medium", "medium" if severe else "low")
    shown = name.replace("_", "-")
    return Rule(76, "message", "content", level, "T1566", f"concat('{shown} lure wording: ', array_join(slice({name}, 1, 3), ', '))", f"size({name}) > 0")


#: Columns that rules of a grain use beside its facts, from functions over them.
def _derived(grain: str) -> dict[str, Column]:
    if grain == "link":
        url = F.col("url")
        raw = T.raw_host(url)
        host = T.canonical_host(raw)
        return {"raw": raw, "host": host, "at": T.defang_host(host), "defanged": T.defang_url(url), "domain": T.registrable_domain(host), "hosting": T.hosting_kind(url), "stored": T.stored_web_page(url), "is_ip": T.is_ip(host), "path": T.path_of(url), "asked": F.lower(F.concat(T.path_of(url), F.lit("?"), T.query_of(url))), "authority": F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "shown_base": T.registrable_domain(F.lower(F.regexp_extract("shown", r"(?i)(?:https?://)?((?:[a-z0-9-]+\.)+[a-z]{2,24})", 1)))}
    if grain == "message":
        return {"mixed_name": T.mixed_scripts(F.col("display")), "mixed_subject": T.mixed_scripts(F.col("subject")), "free_host": F.col("from_domain").rlike("(?:" + "|".join(e.replace(".", r"\.") for e in K.FREE_HOSTING) + ")$")}
    if grain == "code":
        url = T.clean_url(F.col("payload"))
        host = T.host_of(url)
        return {"url": url, "host": host, "domain": T.registrable_domain(host), "hosting": T.hosting_kind(url), "is_ip": T.is_ip(host), "asked": F.lower(F.concat(T.path_of(url), F.lit("?"), T.query_of(url)))}
    return {}


_QR_REASONS = (
    "filter(array(CASE WHEN is_ip THEN 'a raw IP address' END, nullif(hosting, ''), CASE WHEN " + _in("domain", K.SHORTENERS) + " THEN 'a shortener' END, CASE WHEN "
    + _in(_TLD, K.SUSPICIOUS_TLDS) + " THEN 'a high-abuse TLD' END, CASE WHEN lookalike THEN 'a lookalike domain' END, CASE WHEN asked RLIKE '"
    + "|".join(K.CREDENTIAL_WORDS) + "' THEN 'a credential page' END, CASE WHEN exists(recipients, r -> contains(lower(payload), lower(r))) THEN 'the recipient''s address' END), r -> r IS NOT NULL)"
)

RULES = (
    Rule(1, "message", "policy", "high", "T1566", "concat('domain ', blocked[0], ' is on your block list')", "size(blocked) > 0"),
    _auth("spf", ("fail", "softfail", "permerror", "temperror", "none")),
    _auth("dkim", ("fail", "permerror", "temperror", "none")),
    _auth("dmarc", ("fail", "permerror", "temperror")),
    Rule(3, "message", "auth", "medium", "T1036", "concat('forged Authentication-Results: ', array_join(forged_claims, ', '))", "size(forged_claims) > 0"),
    Rule(4, "message", "auth", "low", "", "concat('an earlier Authentication-Results header claims ', array_join(earlier_claims, ', '))", "size(earlier_claims) > 0"),
    Rule(5, "message", "auth", "high", "T1656,T1036", "concat('sender address uses ', from_base, ', but the message is not authenticated for it')", f"auth_seen AND NOT protected AND trusted AND NOT {_FREEMAIL} AND dkim <> 'pass' AND dmarc IN ('fail', 'none', '') AND (dkim <> '' OR dmarc <> '')"),
    Rule(6, "message", "evasion", "medium", "T1027", "'subject written in styled Unicode letters'", r"regexp_count(subject, '[\\x{1D400}-\\x{1D7FF}\\x{24B6}-\\x{24E9}\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}]') >= 4"),
    Rule(7, "message", "evasion", "medium", "T1027", "'invisible characters inside the subject'", r"regexp_count(subject, '[\\x{200B}\\x{2060}]|(?<=[A-Za-z])[\\x{200C}\\x{200D}\\x{00AD}](?=[A-Za-z])') >= 2"),
    Rule(9, "message", "sender", "low", "", "concat('Reply-To goes to the mailing list at ', reply_base)", "reply_base <> '' AND reply_base <> from_base AND array_contains(list_bases, reply_base)"),
    Rule(10, "message", "sender", _if("mailing_list", "medium", "high"), "T1656", "concat('Reply-To domain (', reply_base, ') differs from From domain (', from_base, ')')", "reply_base <> '' AND reply_base <> from_base AND NOT array_contains(list_bases, reply_base)"),
    Rule(11, "message", "sender", "high", "T1656,T1036", "concat('From address hides its real domain ', quoted_domain, ' behind a quoted address (', quoted_from, ')')", "quoted_from <> '' AND quoted_domain <> ''"),
    Rule(12, "message", "sender", "high", "T1656,T1036", "concat('From address is a quoted name (', quoted_from, ') with no domain of its own')", "quoted_from <> '' AND quoted_domain = ''"),
    Rule(13, "message", "sender", "medium", "T1585.002", "concat('sender address is on free web hosting (', from_domain, ')')", "free_host"),
    Rule(16, "message", "sender", "high", "T1036", "'display name mixes alphabets inside a word: look-alike letters'", "mixed_name"),
    Rule(17, "message", "evasion", "medium", "T1036", "'subject mixes alphabets inside a word: look-alike letters'", "mixed_subject"),
    Rule(18, "message", "sender", "medium", "T1656", f"concat('display name shows a different address (', lower(regexp_extract(display, {_EMAIL}, 0)), ')')", f"regexp_extract(display, {_EMAIL}, 0) <> '' AND lower(regexp_extract(display, {_EMAIL}, 0)) <> lower(from_address)"),
    Rule(19, "message", "sender", "medium", "T1656,T1585.002", "concat('display name ''', display, ''' reads as an organisation but the address is free-mail (', from_base, ')')", f"{_FREEMAIL} AND {_ORGANISATION.format('display')}"),
    Rule(22, "message", "sender", "medium", "T1656", "concat('forwarded original: ''', forwarded_display, ''' writes from free-mail (', forwarded_base, ')')", f"{_in('forwarded_base', K.FREEMAIL)} AND {_ORGANISATION.format('forwarded_display')}"),
    Rule(68, "message", "evasion", "medium", "T1027", "concat(zero_width, ' zero-width characters hidden in the body (filter evasion)')", "zero_width >= 3"),
    Rule(69, "message", "evasion", "high", "T1027", "concat('hidden text breaks up words in ', hidden_splits, ' places, so filters read something else than the reader')", "hidden_splits >= 2"),
    Rule(70, "message", "evasion", "medium", "T1027", "'hidden text sits inside a visible word (filter evasion)'", "hidden_splits = 1"),
    Rule(71, "message", "evasion", "medium", "T1027", "concat(tag_splits, ' words broken up with HTML tags')", "tag_splits >= 8"),
    Rule(72, "message", "evasion", "medium", "T1027", "concat(hidden_filler, ' letters of hidden text the reader never sees')", "hidden_filler > 0"),
    Rule(73, "message", "evasion", "medium", "T1027", "concat('hidden text vouches for the message (''', hidden_claim, ''')')", "hidden_claim <> ''"),
    _language("credential", True), _language("crypto", True), _language("payment", False), _language("prize", False), _language("job", False), _language("extortion", True), _language("advance_fee", False), _language("delivery", False),
    Rule(77, "message", "content", _if(f"n_urls = 0 OR {_FREEMAIL}"), "T1566.004,T1656", "concat('callback-phishing pattern: ', callback[0], ', and a number to call (', phone, ')')", "size(callback) > 0 AND length(regexp_replace(phone, '[^0-9]', '')) >= 10"),
    Rule(78, "message", "content", "high", "T1657", "concat('asks for payment to a ', wallets[0], ' wallet')", "size(wallets) > 0 AND size(concat(extortion, advance_fee, crypto, payment, prize)) > 0"),
    Rule(79, "message", "content", "low", "T1657", "concat(wallets[0], ' wallet address in the message')", "size(wallets) > 0 AND size(concat(extortion, advance_fee, crypto, payment, prize)) = 0"),
    Rule(80, "message", "content", _if("n_urls = 0 AND (size(credential) > 0 OR lower(body) RLIKE 'mfa|authenticat')"), "T1566.002", "concat('QR-code lure: ''', qr[0], ''' with an image')", "size(qr) > 0 AND image"),
    Rule(81, "message", "content", "medium", "T1656,T1657", f"concat('free-mail sender asks for money (', {_MONEY}[0], '): business email compromise pattern')", f"{_FREEMAIL} AND n_urls = 0 AND size({_MONEY}) > 0"),
    Rule(82, "message", "content", "medium", "T1656,T1566", "concat('free-mail sender offers a job (', job[0], '): recruitment-scam pattern')", f"{_FREEMAIL} AND size(job) > 0"),
    Rule(83, "message", "content", "high", "T1656,T1657", f"concat('business email compromise: ', lookalike_own[0], ' asks for money (', {_MONEY}[0], ')')", f"size(lookalike_own) > 0 AND size({_MONEY}) > 0"),
    Rule(84, "message", "evasion", "medium", "T1027", "'text split into single letters to dodge keyword filters'", r"body RLIKE '(?U)(?:\\b[^\\W\\d_] ){10,}'"),
    Rule(85, "message", "content", "low", "T1566", "'greets the recipient by email address instead of by name'", r"substr(body, 1, 600) RLIKE '(?i)(?:dear|hello|hi|attention)\\s+[a-z0-9._%+-]+@[a-z0-9-]+[.][a-z]'"),
    Rule(86, "message", "content", "low", "T1566", "'random token in subject (filter evasion)'", "exists(regexp_extract_all(subject, '(?<![A-Za-z0-9])[A-Za-z0-9]{12,40}(?![A-Za-z0-9])', 0), t -> regexp_count(t, '[a-z](?=[A-Z])') >= 4 AND regexp_count(t, '[a-z]') >= 3)"),
    Rule(87, "message", "content", "low", "T1566", "'recipient''s address pasted into the subject (mail-merge lure)'", "exists(recipients, r -> r <> '' AND contains(lower(subject), lower(r)))"),
    Rule(88, "message", "evasion", "high", "T1027", "'MIME parts nested deeper than a mail parser can follow'", "too_deep OR mime_depth >= 1000"),
    Rule(89, "message", "evasion", "medium", "T1027", "concat('MIME parts nested ', mime_depth, ' levels deep; real mail stays under five (filter evasion)')", "mime_depth > 15 AND mime_depth < 1000 AND NOT too_deep"),
    Rule(90, "message", "evasion", "medium", "T1027", "concat(urls_dropped, ' more links than the ', urls_checked, ' checked: a flood of links can bury the one that matters')", "urls_dropped > 0"),
    Rule(24, "link", "link", _if(_in(_FETCHED, K.RUNNABLE_DOWNLOADS)), "T1204.001,T1566.002", f"concat('link downloads a .', {_FETCHED}, ' file: ', defanged)", f"NOT trusted AND clicked AND {_in(_FETCHED, K.RUNNABLE_DOWNLOADS + K.PACKED_DOWNLOADS)}"),
    Rule(25, "link", "link", "high", "T1608.005", "concat('URL points at a raw IP: ', defanged)", "is_ip"),
    Rule(26, "link", "link", "high", "T1027,T1608.005", "concat('URL disguises the IP address ', at, ' as ', replace(raw, '.', '[.]'))", "raw <> host AND is_ip"),
    Rule(27, "link", "link", "high", "T1583.001", "concat('punycode URL host: ', at)", "contains(host, 'xn--')"),
    Rule(28, "link", "link", "medium", "T1608.005", "concat('shortened link: ', at)", _in("domain", K.SHORTENERS)),
    Rule(29, "link", "link", "low", "T1583.001", "concat('high-abuse TLD in ', at)", f"NOT is_ip AND {_in(_TLD, K.SUSPICIOUS_TLDS)}"),
    Rule(30, "link", "link", "low", "T1598.003", "concat('credential-harvesting path on ', at)", f"NOT trusted AND clicked AND asked RLIKE '{_LONG}|(?<![a-z0-9])(?:{_SHORT})(?![a-z0-9])'"),
    Rule(31, "link", "link", "high", "T1036", "concat('URL hides its real host behind ''@'': ', defanged)", "contains(authority, '@')"),
    Rule(32, "link", "link", _if(f"flagged OR shown_known OR hosting <> '' OR {_in(_TLD, K.SUSPICIOUS_TLDS)}"), "T1036,T1566.002", "concat('link text/href mismatch: ', replace(shown_base, '.', '[.]'), ' shown, ', at, ' real')", "shown_base <> '' AND shown_base <> domain"),
    Rule(33, "link", "link", "medium", "T1608.005", "concat(wrapped_by, ' hides the real destination: ', replace(redirect_to, '.', '[.]'))", "redirect_to <> '' AND NOT target_trusted"),
    Rule(34, "link", "link", "medium", "T1583.006", "concat('link opens a web page kept on cloud storage: ', at)", "clicked AND stored"),
    Rule(35, "link", "link", _if("hosting = 'tunnel or IPFS'", "medium", "low"), "T1583.006", "concat('link to ', hosting, ': ', at)", "hosting <> '' AND NOT (clicked AND stored)"),
    Rule(74, "link", "link", "medium", "T1027.006", "'a link runs JavaScript instead of opening a website'", "lower(url) LIKE 'javascript:%'"),
    Rule(75, "link", "link", "high", "T1027.006,T1566.002", "'a link opens a page built into the link itself'", "lower(url) LIKE 'data:text/html%'"),
    Rule(65, "link", "attachment", "high", "T1027", "concat('obfuscated URL decoded from base64: ', url)", "decoded"),
    Rule(36, "file", "attachment", "high", "T1566.001,T1204.002", "concat('risky attachment: ', filename)", f"NOT inline AND {_in(_HELD, K.RISKY_EXTENSIONS)}"),
    Rule(37, "file", "attachment", "low", "T1566.001", "concat('archive attachment: ', filename)", f"NOT inline AND archive_kind = '' AND {_in(_HELD, K.ARCHIVE_EXTENSIONS)}"),
    Rule(38, "file", "attachment", "high", "T1036.007", "concat('double extension: ', filename)", "NOT inline AND lower(filename) RLIKE '[.](pdf|docx?|xlsx?|pptx?|jpe?g|png|txt|csv|rtf|wav|mp3|mp4)[.][a-z0-9]{2,5}$'"),
    Rule(39, "file", "attachment", "high", "T1036.002", "'RTL-override filename trick'", r"NOT inline AND contains(filename, '‮')"),
    Rule(40, "file", "attachment", "high", "T1036.008", f"concat(filename, ' claims to be .', {_HELD}, ' but is ', true_type)", f"NOT inline AND {_in('true_type', K.DANGEROUS_TYPES)} AND (" + " OR ".join(f"({_HELD} = '{e}'" + (f" AND NOT {_in('true_type', t)})" if t else ")") for e, t in K.EXPECTED_TYPES.items()) + ")"),
    Rule(41, "file", "attachment", "high", "T1204.002,T1059.005", "concat('macro-enabled document: ', filename)", "NOT inline AND macro"),
    Rule(42, "file", "attachment", "high", "T1553.005,T1566.001", "concat('disk image ', filename, ' delivers ', members, ' file(s) without the Mark of the Web')", "NOT inline AND contains(archive_kind, 'disk image') AND members > 0"),
    Rule(43, "file", "attachment", "low", "T1566.001", "concat('archive attachment: ', filename)", "NOT inline AND archive_kind NOT IN ('', 'gzip file') AND NOT contains(archive_kind, 'disk image')"),
    Rule(44, "file", "attachment", "high", "T1027.013,T1566.001", "concat('the message gives the password for its ', archive_kind, ' ', filename, ', so no gateway could look inside')", "NOT inline AND password <> ''"),
    Rule(45, "file", "attachment", "high", "T1027.013", "concat('archive ', filename, ' encrypts even its file names')", "NOT inline AND names_hidden"),
    Rule(46, "file", "attachment", "high", "T1027.013", "concat('password-protected archive: ', filename)", "NOT inline AND encrypted AND NOT names_hidden"),
    Rule(47, "file", "attachment", "high", "T1566.001,T1204.002", "concat(filename, ' holds ', unseen_risky, ' risky file(s)')", "NOT inline AND unseen_risky > 0"),
    Rule(48, "file", "attachment", "high", "T1204.002", "concat('shortcut ', filename, ' ', array_join(lnk, ', '))", "NOT inline AND size(lnk) > 0"),
    Rule(49, "file", "attachment", _if("arrays_overlap(office, array('xlm-macro', 'dde', 'protocol-handler', 'remote-attachedtemplate', 'remote-oleobject', 'remote-frame', 'remote-subdocument', 'embedded-package'))"), "T1204.002", "concat('document ', filename, ' has ', array_join(office, ', '))", "NOT inline AND arrays_overlap(office, array('xlm-macro', 'dde', 'protocol-handler', 'remote-attachedtemplate', 'remote-oleobject', 'remote-frame', 'remote-subdocument', 'embedded-package', 'activex', 'encrypted'))"),
    Rule(50, "file", "attachment", "high", "T1204.002,T1059.005", "concat('macro-enabled document: ', filename)", "NOT inline AND array_contains(office, 'vba-macro') AND NOT macro"),
    Rule(51, "file", "attachment", "high", "T1204.002", "concat('PDF ', filename, ' has a launch action that starts a program')", "NOT inline AND array_contains(pdf, 'launch')"),
    Rule(52, "file", "attachment", _if("arrays_overlap(pdf, array('open-action', 'auto-action'))"), "T1059.007,T1204.002", "concat('PDF ', filename, ' runs JavaScript')", "NOT inline AND array_contains(pdf, 'javascript')"),
    Rule(53, "file", "attachment", "medium", "T1027,T1204.002", "concat('PDF ', filename, ' carries an embedded file')", "NOT inline AND array_contains(pdf, 'embedded-file')"),
    Rule(54, "file", "attachment", "medium", "T1598.002", "concat('PDF ', filename, ' has a form that submits what is typed into it')", "NOT inline AND array_contains(pdf, 'submit-form')"),
    Rule(55, "file", "attachment", "high", "T1203", "concat('RTF ', filename, ' carries an Equation Editor object')", "NOT inline AND arrays_overlap(rtf, array('class-equation.3', 'class-equation'))"),
    Rule(56, "file", "attachment", "high", "T1203", "concat('RTF ', filename, ' carries an OLE object used by known exploits')", "NOT inline AND arrays_overlap(rtf, array('class-htmlfile', 'class-otkloadr.wrassembly'))"),
    Rule(57, "file", "attachment", "high", "T1221", "concat('RTF ', filename, ' loads a remote template when opened')", "NOT inline AND array_contains(rtf, 'remote-template')"),
    Rule(58, "file", "attachment", "high", "T1204.002", "concat('RTF ', filename, ' carries an embedded file (Package object)')", "NOT inline AND array_contains(rtf, 'class-package')"),
    Rule(59, "file", "attachment", "medium", "T1204.002", "concat('RTF ', filename, ' carries embedded OLE objects')", "NOT inline AND array_contains(rtf, 'ole-object') AND NOT array_contains(rtf, 'class-package')"),
    Rule(60, "file", "attachment", _if("risky_child"), "T1204.002,T1027", "concat('OneNote file ', filename, ' hides ', members, ' file(s)')", "NOT inline AND true_type = 'onenote' AND members > 0"),
    Rule(61, "file", "attachment", "high", "T1027.006,T1059.007", "concat('SVG image ', filename, ' runs JavaScript (SVG smuggling)')", f"NOT inline AND scripts AND (true_type = 'svg' OR {_HELD} = 'svg')"),
    Rule(62, "file", "attachment", "high", "T1598.002", "concat('HTML attachment ', filename, ' contains a credential form')", "NOT inline AND password_form"),
    Rule(63, "file", "attachment", "high", "T1027.006", "concat('HTML smuggling code in ', filename)", "NOT inline AND smuggling >= 2"),
    Rule(64, "file", "attachment", "medium", "T1608.005", "concat('HTML attachment ', filename, ' redirects to ', redirect)", "NOT inline AND redirect <> ''"),
    Rule(66, "file", "attachment", "low", "T1566.002", "concat('calendar invitation (', filename, ') carries ', calendar_links, ' link(s)')", "NOT inline AND calendar_links > 0"),
    Rule(67, "file", "attachment", "medium", "T1656", "concat('calendar organiser ', organiser_base, ' is not the sender ', from_base)", "NOT inline AND organiser_base <> '' AND organiser_base <> from_base AND NOT list_member"),
    Rule(92, "lookup", "intel", "high", "T1566.002,T1204.001", "concat('VirusTotal: ', value, ' flagged by ', malicious, ' engines')", "kind = 'vt_url' AND status = 'ok' AND malicious >= 2"),
    Rule(93, "lookup", "intel", "medium", "T1566.002", "concat('VirusTotal: ', value, ' has minority detections')", "kind = 'vt_url' AND status = 'ok' AND malicious < 2 AND malicious + suspicious > 0"),
    Rule(94, "lookup", "intel", "medium", "T1608.005", "concat('urlscan.io: malicious verdicts on ', value)", "kind = 'urlscan' AND status = 'ok' AND malicious > 0"),
    Rule(95, "lookup", "intel", "high", "T1566.001,T1204.002", "concat('VirusTotal: ', value, ' flagged by ', malicious, ' engines')", "kind = 'vt_file' AND status = 'ok' AND malicious >= 2"),
    Rule(96, "lookup", "intel", "medium", "T1566.001", "concat('VirusTotal: ', value, ' has minority detections')", "kind = 'vt_file' AND status = 'ok' AND malicious < 2 AND malicious + suspicious > 0"),
    Rule(97, "lookup", "intel", _if("age < 30", "medium", "low"), "T1583.001", "concat('the message names ', value, ', registered ', age, ' day(s) ago')", "kind = 'rdap' AND status = 'ok' AND named AND age < 90"),
    Rule(98, "lookup", "intel", "high", "T1583.001", "concat(value, ' was registered ', age, ' day(s) ago')", "kind = 'rdap' AND status = 'ok' AND NOT named AND age < 30"),
    Rule(99, "lookup", "intel", "medium", "T1583.001", "concat(value, ' is only ', age, ' days old')", "kind = 'rdap' AND status = 'ok' AND NOT named AND age >= 30 AND age < 90"),
    Rule(100, "lookup", "intel", "medium", "T1656", "concat('sender domain ', value, ' does not exist in DNS')", "kind = 'dns' AND status = 'not_found'"),
    Rule(101, "lookup", "intel", "low", "T1656", "concat('sender domain ', value, ' has no mail server (no MX or A record)')", "kind = 'dns' AND status = 'ok' AND NOT has_mx AND NOT has_a"),
    Rule(102, "lookup", "intel", "high", "", "concat('originating IP ', value, ' has AbuseIPDB confidence ', score, '%')", "kind = 'abuseipdb' AND status = 'ok' AND score >= 75"),
    Rule(103, "lookup", "intel", "medium", "", "concat('originating IP ', value, ' has AbuseIPDB confidence ', score, '%')", "kind = 'abuseipdb' AND status = 'ok' AND score >= 25 AND score < 75"),
    Rule(104, "code", "link", "medium", "T1566", "concat('QR code in ', place, ' calls or texts ', payload)", "lower(payload) RLIKE '^(?:tel|sms|smsto):'"),
    Rule(105, "code", "link", f"CASE WHEN size({_QR_REASONS}) = 0 AND domain = from_base AND dmarc = 'pass' THEN 'low' WHEN size({_QR_REASONS}) > 0 OR lure THEN 'high' ELSE 'medium' END", "T1566.002", f"concat('QR code in ', place, ' links to ', replace(host, '.', '[.]'), CASE WHEN size({_QR_REASONS}) > 0 THEN concat(' (', array_join({_QR_REASONS}, ', '), ')') ELSE '' END)", "host <> '' AND lower(url) RLIKE '^https?://'"),
)


def signals(facts: DataFrame, grain: str, key: str = "msg_id") -> DataFrame:
    """key, ord, rule, severity, label, family, techniques of each rule of the grain that holds for a row of facts.

    Facts that are missing or null have the value in FACTS; other columns are not read. ``ord`` is the rule's place in the
    catalogue. A row for which no rule holds gives none.
    """
    have = set(facts.columns)
    rows = facts.select(key, *[(F.coalesce(F.col(n).cast(t), F.expr(d).cast(t)) if n in have else F.expr(d).cast(t)).alias(n) for n, (t, d) in FACTS[grain].items()])
    rows = rows.withColumns(_derived(grain))
    found = []
    for place, rule in enumerate(RULES):
        if rule.grain == grain:
            level = F.expr(rule.severity) if rule.severity.startswith("CASE") else F.lit(rule.severity)
            tags = F.split(F.lit(rule.techniques), ",") if rule.techniques else F.array().cast("array<string>")
            found.append(F.when(F.expr(rule.test), F.struct(F.lit(place).alias("ord"), F.lit(rule.number).alias("rule"), level.alias("severity"), F.expr(rule.label).alias("label"), F.lit(rule.family).alias("family"), tags.alias("techniques"))))
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("s")).select(key, "s.*")
