"""The rule catalogue over every page: a page's number picks a case of facts, and the rules judge it.

The driver's tables hold no mail, so that facts are literal cases, one for each page by its number. Expected rules are
written by hand for each case, from what the rules say, and are the SQL side: nothing of the rules' code is in it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.operators import catalogue, scoring
from lurescope.runtime import table

#: Per grain: (facts, "rule severity" of each rule that holds, in the order of the catalogue).
CASES: dict[str, list[tuple[dict, str]]] = {
    "message": [
        ({}, ""),
        ({"blocked": ["bad[.]top"]}, "1high"),
        ({"spf": "fail", "dkim": "none", "dmarc": "fail"}, "2high 2medium 2high"),
        ({"spf": "softfail", "dkim": "pass", "dmarc": "none"}, "2medium"),
        ({"forged_claims": ["spf=pass"], "earlier_claims": ["dkim=pass"]}, "3medium 4low"),
        ({"auth_seen": True, "trusted": True, "from_base": "brand.com", "dkim": "none", "dmarc": "none"}, "2medium 5high"),
        ({"auth_seen": True, "trusted": True, "protected": True, "from_base": "brand.com", "dkim": "none"}, "2medium"),
        ({"auth_seen": True, "trusted": True, "from_base": "gmail.com", "dkim": "none"}, "2medium"),
        ({"subject": "\U0001d400\U0001d401\U0001d402\U0001d403 plain"}, "6medium"),
        ({"subject": "pass\u200bwo\u2060rd"}, "7medium"),
        ({"from_base": "a.com", "reply_base": "b.com"}, "10high"),
        ({"from_base": "a.com", "reply_base": "b.com", "mailing_list": True}, "10medium"),
        ({"from_base": "a.com", "reply_base": "list.org", "list_bases": ["list.org"]}, "9low"),
        ({"quoted_from": "x@bank.com", "quoted_domain": "evil.top"}, "11high"),
        ({"quoted_from": "x@bank.com"}, "12high"),
        ({"from_domain": "pay.web.app", "from_base": "web.app"}, "13medium"),
        ({"display": "P\u0430yPal", "subject": "n\u03bftice"}, "16high 17medium"),
        ({"display": "Boss boss@corp.com", "from_address": "x@evil.top"}, "18medium"),
        ({"display": "Boss BOSS@corp.com", "from_address": "boss@corp.com"}, ""),
        ({"display": "Payroll Team", "from_base": "gmail.com"}, "19medium"),
        ({"display": "Ann Smith", "from_base": "gmail.com"}, ""),
        ({"forwarded_display": "IT desk", "forwarded_base": "aol.com"}, "22medium"),
        ({"zero_width": 3, "hidden_splits": 2, "tag_splits": 8}, "68medium 69high 71medium"),
        ({"hidden_splits": 1, "hidden_filler": 400, "hidden_claim": "this mail is safe"}, "70medium 72medium 73medium"),
        ({"zero_width": 2, "tag_splits": 7}, ""),
        ({"credential": ["verify your account", "sign in now"], "n_urls": 1}, "76high"),
        ({"credential": ["verify your account"], "delivery": ["your parcel"], "n_urls": 1}, "76medium 76low"),
        ({"callback": ["call us"], "phone": "+1 (888) 555-0100", "n_urls": 2, "from_base": "a.com"}, "77medium"),
        ({"callback": ["call us"], "phone": "555-0100"}, ""),
        ({"wallets": ["BTC"], "extortion": ["your webcam"]}, "76medium 78high"),
        ({"wallets": ["BTC"]}, "79low"),
        ({"qr": ["scan the code"], "image": True, "body": "MFA will expire"}, "80high"),
        ({"qr": ["scan the code"], "image": True, "n_urls": 1}, "80medium"),
        ({"qr": ["scan the code"]}, ""),
        ({"from_base": "gmail.com", "payment": ["wire transfer"]}, "76low 81medium"),
        ({"from_base": "gmail.com", "prize": ["you won"]}, "76low"),
        ({"from_base": "gmail.com", "prize": ["a gift card", "you won"], "lookalike_own": ["c0rp[.]com"]}, "76medium 81medium 83high"),
        ({"from_base": "qq.com", "job": ["remote job"], "n_urls": 1}, "76low 82medium"),
        ({"body": "x P a s s w o r d n o w please"}, "84medium"),
        ({"body": "Dear ann@corp.com, hello"}, "85low"),
        ({"subject": "Invoice aBcDeFgHiJkL"}, "86low"),
        ({"subject": "For Ann@Corp.com only", "recipients": ["ann@corp.com"]}, "87low"),
        ({"mime_depth": 16, "urls_dropped": 12, "urls_checked": 1000}, "89medium 90medium"),
        ({"too_deep": True}, "88high"),
    ],
    "link": [
        ({"url": "https://plain.com/about"}, ""),
        ({"url": "https://plain.com/a/setup.exe", "clicked": True}, "24high"),
        ({"url": "https://plain.com/a/files.zip/", "clicked": True}, "24medium"),
        ({"url": "https://plain.com/a/setup.exe"}, ""),
        ({"url": "https://plain.com/a/setup.exe", "clicked": True, "trusted": True}, ""),
        ({"url": "http://10.2.3.4/x"}, "25high"),
        ({"url": "http://0xC0A80101/x"}, "25high 26high"),
        ({"url": "https://xn--pypal-4ve.com/"}, "27high"),
        ({"url": "https://www.bit.ly/abc"}, "28medium"),
        ({"url": "https://shop.evil.top/"}, "29low"),
        ({"url": "https://plain.com/webmail/", "clicked": True}, "30low"),
        ({"url": "https://plain.com/?next=sso", "clicked": True}, "30low"),
        ({"url": "https://plain.com/OssoJ", "clicked": True}, ""),
        ({"url": "https://plain.com/webmail/", "clicked": True, "trusted": True}, ""),
        ({"url": "https://bank.com@evil.net/"}, "31high"),
        ({"url": "https://track.net/1", "shown": "www.bank.com"}, "32medium"),
        ({"url": "https://track.net/1", "shown": "https://bank.com/x", "shown_known": True}, "32high"),
        ({"url": "https://track.net/1", "shown": "go to track.net"}, ""),
        ({"url": "https://evil.xyz/1", "shown": "bank.com"}, "29low 32high"),
        ({"url": "https://www.google.com/url?q=https://evil.net", "redirect_to": "evil.net", "wrapped_by": "Google redirect"}, "33medium"),
        ({"url": "https://www.google.com/url?q=https://ok.net", "redirect_to": "ok.net", "target_trusted": True}, ""),
        ({"url": "https://b.s3.amazonaws.com/page.html", "clicked": True}, "34medium"),
        ({"url": "https://b.s3.amazonaws.com/page.html"}, "35low"),
        ({"url": "https://abc.ngrok.io/"}, "35medium"),
        ({"url": "https://we.tl/t-abc"}, "35low"),
        ({"url": "javascript:alert(1)"}, "74medium"),
        ({"url": "data:text/html;base64,AAAA"}, "75high"),
        ({"url": "https://plain.com/x", "decoded": True}, "65high"),
    ],
    "file": [
        ({"filename": "report.pdf", "true_type": "pdf"}, ""),
        ({"filename": "run.EXE", "true_type": "pe"}, "36high"),
        ({"filename": "run.exe", "true_type": "pe", "inline": True}, ""),
        ({"filename": "a.cab", "true_type": "cab"}, "37low"),
        ({"filename": "bill.pdf.js"}, "36high 38high"),
        ({"filename": "photo\u202egnp.scr", "true_type": "pe"}, "36high 39high"),
        ({"filename": "bill.pdf", "true_type": "html"}, "40high"),
        ({"filename": "pic.jpg", "true_type": "png"}, ""),
        ({"filename": "notes.txt", "true_type": "zip"}, "40high"),
        ({"filename": "old.doc", "true_type": "ole", "macro": True}, "41high"),
        ({"filename": "d.iso", "true_type": "iso", "archive_kind": "ISO disk image", "members": 2}, "36high 42high"),
        ({"filename": "d.zip", "true_type": "zip", "archive_kind": "ZIP file", "password": "1234", "encrypted": True}, "43low 44high 46high"),
        ({"filename": "d.rar", "true_type": "rar", "archive_kind": "RAR file", "names_hidden": True, "encrypted": True}, "43low 45high"),
        ({"filename": "d.gz", "true_type": "gzip", "archive_kind": "gzip file", "unseen_risky": 1}, "47high"),
        ({"filename": "x.lnk", "true_type": "lnk", "lnk": ["starts powershell"]}, "36high 48high"),
        ({"filename": "x.docx", "true_type": "zip", "office": ["remote-attachedtemplate"]}, "49high"),
        ({"filename": "x.docx", "true_type": "zip", "office": ["activex", "vba-macro"]}, "49medium 50high"),
        ({"filename": "x.pdf", "true_type": "pdf", "pdf": ["launch", "javascript", "open-action"]}, "51high 52high"),
        ({"filename": "x.pdf", "true_type": "pdf", "pdf": ["javascript", "embedded-file", "submit-form"]}, "52medium 53medium 54medium"),
        ({"filename": "x.rtf", "true_type": "rtf", "rtf": ["ole-object", "class-equation.3"]}, "55high 59medium"),
        ({"filename": "x.rtf", "true_type": "rtf", "rtf": ["ole-object", "class-package", "remote-template"]}, "57high 58high"),
        ({"filename": "x.rtf", "true_type": "rtf", "rtf": ["class-htmlfile", "class-equationless"]}, "56high"),
        ({"filename": "n.one", "true_type": "onenote", "members": 1, "risky_child": True}, "36high 60high"),
        ({"filename": "p.svg", "true_type": "svg", "scripts": True}, "36high 61high"),
        ({"filename": "f.html", "true_type": "html", "password_form": True, "smuggling": 2, "redirect": "https://e.top"}, "36high 62high 63high 64medium"),
        ({"filename": "i.ics", "true_type": "calendar", "calendar_links": 2, "organiser_base": "a.com", "from_base": "b.com"}, "66low 67medium"),
        ({"filename": "i.ics", "organiser_base": "a.com", "from_base": "a.com"}, ""),
    ],
    "lookup": [
        ({"kind": "vt_url", "status": "ok", "value": "e[.]top", "malicious": 2, "suspicious": 0}, "92high"),
        ({"kind": "vt_url", "status": "ok", "value": "e[.]top", "malicious": 1, "suspicious": 0}, "93medium"),
        ({"kind": "vt_url", "status": "error", "malicious": 9, "suspicious": 0}, ""),
        ({"kind": "urlscan", "status": "ok", "value": "e[.]top", "malicious": 1}, "94medium"),
        ({"kind": "vt_file", "status": "ok", "value": "a.exe", "malicious": 5, "suspicious": 0}, "95high"),
        ({"kind": "vt_file", "status": "ok", "value": "a.exe", "malicious": 0, "suspicious": 3}, "96medium"),
        ({"kind": "vt_file", "status": "ok", "value": "a.exe", "malicious": 0, "suspicious": 0}, ""),
        ({"kind": "rdap", "status": "ok", "value": "e[.]top", "age": 29, "named": True}, "97medium"),
        ({"kind": "rdap", "status": "ok", "value": "e[.]top", "age": 89, "named": True}, "97low"),
        ({"kind": "rdap", "status": "ok", "value": "e[.]top", "age": 29}, "98high"),
        ({"kind": "rdap", "status": "ok", "value": "e[.]top", "age": 30}, "99medium"),
        ({"kind": "rdap", "status": "ok", "value": "e[.]top", "age": 90}, ""),
        ({"kind": "dns", "status": "not_found", "value": "e[.]top"}, "100medium"),
        ({"kind": "dns", "status": "ok", "value": "e[.]top"}, "101low"),
        ({"kind": "dns", "status": "ok", "value": "e[.]top", "has_a": True}, ""),
        ({"kind": "abuseipdb", "status": "ok", "value": "9.9.9.9", "score": 75}, "102high"),
        ({"kind": "abuseipdb", "status": "ok", "value": "9.9.9.9", "score": 25}, "103medium"),
        ({"kind": "abuseipdb", "status": "ok", "value": "9.9.9.9", "score": 24}, ""),
    ],
    "code": [
        ({"payload": "tel:+18885550100", "place": "a.png"}, "104medium"),
        ({"payload": "https://own.com/x", "place": "a.png", "from_base": "own.com", "dmarc": "pass"}, "105low"),
        ({"payload": "https://own.com/x", "place": "a.png", "from_base": "own.com", "dmarc": "fail"}, "105medium"),
        ({"payload": "https://own.com/login", "place": "a.png", "from_base": "own.com", "dmarc": "pass"}, "105high"),
        ({"payload": "www.other.com/x", "place": "a.png", "lure": True}, "105high"),
        ({"payload": "https://other.com/ann@corp.com", "place": "a.png", "recipients": ["Ann@corp.com"]}, "105high"),
        ({"payload": "just text", "place": "a.png"}, ""),
    ],
}

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def cases(spark: SparkSession, grain: str) -> DataFrame:
    """The grain's cases with their facts; a few rows."""
    facts = catalogue.FACTS[grain]
    kinds = ", ".join(f"{n} {t}" for n, (t, _) in facts.items())
    rows = spark.createDataFrame([(i, json.dumps(f)) for i, (f, _) in enumerate(CASES[grain])], "case_no int, body string")
    return rows.select("case_no", F.from_json("body", kinds).alias("f")).select("case_no", "f.*")


def found(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), (F.col("page_id") % len(CASES[grain])).cast("int").alias("case_no"))
    return catalogue.signals(pages.join(F.broadcast(cases(spark, grain)), "case_no"), grain)  # a few dozen rows


def expected(grain: str) -> str:
    rows = [(i, int("".join(c for c in s if c.isdigit())), s.lstrip("0123456789"), n) for i, (_, held) in enumerate(CASES[grain]) for n, s in enumerate(held.split())]
    values = ", ".join(f"({i}, {rule}, '{severity}', {n})" for i, rule, severity, n in rows)
    return f"SELECT page_id AS msg_id, rule, severity, n FROM pages JOIN (VALUES {values}) AS e(case_no, rule, severity, n) ON page_id % {len(CASES[grain])} = case_no"


def _add(grain: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(spark, sf_dir, grain).groupBy("msg_id", "rule", "severity").agg(F.count("*").alias("n"))

    QUERIES[f"rules_{grain}"] = query
    ORACLE_SQL[f"rules_{grain}"] = f"SELECT msg_id, rule, severity, count(*) AS n FROM ({expected(grain)}) GROUP BY ALL"


for _grain in CASES:
    _add(_grain)


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of high and medium signals and the number of high ones, of all grains together."""
    rows = None
    for place, grain in enumerate(CASES):
        part = found(spark, sf_dir, grain).select("msg_id", (F.col("ord") + 1000 * place).alias("ord"), "severity", F.concat(F.lit(f"{grain} "), "label").alias("label"), "family", "techniques")
        rows = part if rows is None else rows.unionByName(part)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"))
    return scoring.scored(pages, rows.where("severity <> 'low'")).select("msg_id", "score", "n_high")


QUERIES["rule_scores"] = rule_scores
ORACLE_SQL["rule_scores"] = "SELECT p.page_id AS msg_id, CAST(coalesce(sum(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END), 0) AS BIGINT) AS score, count(*) FILTER (severity = 'high') AS n_high FROM pages p LEFT JOIN (" + " UNION ALL ".join(expected(g) for g in CASES) + ") s ON s.msg_id = p.page_id GROUP BY p.page_id"
