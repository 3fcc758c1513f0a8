"""Scoring, components, mail parsing, sinks and streaming against small cases with known results."""

import hashlib
import io
import tarfile
import uuid
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from lurescope.operators import scoring
from lurescope.operators.components import connected_components
from lurescope.operators.lookups import lookalikes
from lurescope.sources import archives, sinks
from lurescope.sources.mail import numbered, parse_mail, read_mail, split_mbox
from lurescope.sources.sinks import write_csv
from lurescope.streaming import intake

SIGNALS = "msg_id long, ord int, severity string, label string, family string"


@pytest.mark.parametrize(
    ("rows", "score", "verdict"),
    [
        ([("high", "sender"), ("medium", "link")], 5, "LIKELY PHISHING"),
        ([("high", "auth"), ("medium", "auth")], 5, "SUSPICIOUS"),
        ([("high", ""), ("medium", "")], 5, "SUSPICIOUS"),
        ([("medium", "auth"), ("medium", "link"), ("medium", "content"), ("low", "")], 7, "SUSPICIOUS"),
        ([("medium", "auth"), ("medium", "link"), ("medium", "content"), ("low", ""), ("low", "")], 8, "LIKELY PHISHING"),
        ([("medium", "link"), ("low", ""), ("low", "")], 4, "SUSPICIOUS"),
        ([], 0, "NO STRONG INDICATORS"),
    ],
)
def test_verdicts(spark, rows, score, verdict):
    signals = spark.createDataFrame([(1, i, s, f"label {'abcdefgh'[i]}", f) for i, (s, f) in enumerate(rows)], SIGNALS)
    row = scoring.scored(spark.range(1, 2).withColumnRenamed("id", "msg_id"), signals).first()
    assert (row.score, row.verdict) == (score, verdict)


def test_lows_of_one_kind_count_once_and_the_first_label_wins(spark):
    signals = spark.createDataFrame([(1, 0, "low", "lure: a", ""), (1, 1, "low", "lure: b", ""), (1, 2, "medium", "x", "link"), (1, 3, "high", "x", "link")], SIGNALS)
    row = scoring.scored(spark.range(1, 2).withColumnRenamed("id", "msg_id"), signals).first()
    assert (row.score, row.n_high) == (3, 0)


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(1, n) for n in (5, 7, 9)] + [(9, 100), (9, 100), (3, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {n: 20 for n in range(20, 61)} | {n: 1 for n in (1, 5, 7, 9, 100)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_lookalikes(spark):
    labels = spark.createDataFrame([(x,) for x in ("northwnd", "northwind-login", "nortwhind", "southern", "northwind")], "label string")
    found = {(r.label, r.method) for r in lookalikes(labels, spark.createDataFrame([("northwind",)], "brand string")).collect()}
    assert found == {("northwnd", "typosquat"), ("northwind-login", "combosquat"), ("nortwhind", "typosquat"), ("northwind", "tld-swap")}


def test_mail_files(spark, tmp_path):
    message = EmailMessage()
    message["Subject"], message["From"], message["To"] = "Grüße", "A <a@b.example>", "c@d.example"
    message.set_content("plain text")
    message.add_attachment(b"MZ", maintype="application", subtype="octet-stream", filename="x.exe")
    (tmp_path / "one.eml").write_bytes(bytes(message))
    (tmp_path / "two.mbox").write_bytes(b"From x\n" + bytes(message) + b"\nFrom y\nSubject: second\n\nbody\n")
    (tmp_path / "large.eml").write_bytes(b"Subject: x\n\n" + b"y" * 5000)
    (tmp_path / "other.txt").write_bytes(b"no message")
    rows = numbered(parse_mail(read_mail(spark, str(tmp_path), 4000))).orderBy("path", "number").collect()
    assert [(r.path.rpartition("/")[2], r.number, r.subject, r.error) for r in rows] == [("large.eml", 1, None, "too large"), ("one.eml", 1, "Grüße", None), ("two.mbox", 1, "Grüße", None), ("two.mbox", 2, "second", None)]
    assert rows[1].from_address == "a@b.example" and rows[1].attachments[0].filename == "x.exe" and rows[1].text.strip() == "plain text"
    assert rows[3].label.endswith("two.mbox#2")
    assert split_mbox(b"") == []


def test_csv_cells_are_no_formulas(spark, tmp_path):
    write_csv(spark.createDataFrame([("=1+1", 2)], "a string, b long"), str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).first().a == "'=1+1"


def test_stream_stores_each_message_once(spark, tmp_path):
    source = tmp_path / "in"
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, n long")
    seen = str(tmp_path / "seen")
    for _ in range(2):
        frame.write.mode("append").parquet(str(source))
        intake.once(spark.readStream.schema(frame.schema).parquet(str(source)), seen, "key", str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.key for r in spark.read.parquet(seen).collect()) == ["a", "b"]


def test_a_large_mailbox_spreads_over_tasks_and_loses_no_mail(spark, tmp_path):
    data = b"".join(b"From x\nSubject: m%d\n\n" % i + (b"line %d \xff\n" % i) * 50 + b"\n" for i in range(400))
    (tmp_path / "big.mbox").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = read_mail(spark, str(tmp_path), 10_000)
        assert found.rdd.getNumPartitions() > 5
        rows = numbered(parse_mail(found)).orderBy("number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.subject for r in rows] == [f"m{i}" for i in range(400)]
    # The last message keeps the empty line at the file's end, which no separator takes away.
    assert [r.msg_id for r in rows][:399] == [hashlib.sha256(m).hexdigest() for m in split_mbox(data)][:399]


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as made:
        for name, body in members.items():
            made.writestr(name, body)
    return out.getvalue()


def test_archives_and_document_features(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as made:
        info = tarfile.TarInfo("deep.exe")
        info.size = 4
        made.addfile(info, io.BytesIO(b"MZxx"))
    rels = '<Relationships><Relationship Type="http://x/attachedTemplate" Target="http://e/t.dotm" TargetMode="External"/></Relationships>'
    office = _zip({"[Content_Types].xml": "<x/>", "word/vbaProject.bin": "v", "word/_rels/settings.xml.rels": rels})
    files = [(1, "outer.zip", _zip({"in.tar": tar.getvalue(), "a.pdf": b"%PDF /OpenAction /J#61vaScript"})), (2, "d.docm", office), (3, "x.rtf", b"{\\rtf1 \\object\\objclass Package "), (4, "bad.zip", b"PK\x03\x04broken"), (5, None, None), (6, "s.svg", b"<svg onload='x'>")]
    rows = archives.expand(spark.createDataFrame(files, "msg_id long, filename string, content binary")).collect()
    found = {(r.msg_id, r.filename): r for r in rows}
    assert found[1, "deep.exe"].true_type == "pe" and found[1, "deep.exe"].parent_no == found[1, "in.tar"].file_no and found[1, "outer.zip"].parent_no is None
    assert found[1, "a.pdf"].features == ["javascript", "open-action"]
    assert found[2, "d.docm"].features == ["remote-attachedtemplate", "vba-macro"]
    assert found[3, "x.rtf"].features == ["class-package", "ole-object"]
    assert found[4, "bad.zip"].error and found[5, ""].size == 0 and found[6, "s.svg"].true_type == "svg"


def test_identifiers_are_version_5_uuids(spark):
    name = "indicator|domain|é.net"
    assert spark.range(1).select(sinks.uuid5(sinks.NAMESPACE, F.lit(name)).alias("u")).first().u == str(uuid.uuid5(uuid.UUID(sinks.NAMESPACE), name))


def test_a_message_without_a_key_is_stored_once(spark, tmp_path):
    frame = spark.createDataFrame([(None, 1), (None, 2), ("b", 3)], "key string, n long")
    for _ in range(2):
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        intake.once(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), str(tmp_path / "seen"), "key", str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 2


def test_indicator_selection(spark):
    mail = spark.createDataFrame([(1, "SUSPICIOUS", "x@evil.top", "y@gmail.com", False, "9.9.9.9", False), (2, "NO STRONG INDICATORS", "x@b.net", None, False, None, False)], "msg_id long, verdict string, from_address string, reply_to string, trusted_from boolean, origin_ip string, shared_origin boolean")
    kinds = "msg_id long, ord long, url string, trusted boolean, only_headers boolean, only_text boolean, flagged boolean, claimed boolean"
    links = [(1, 0, "http://a.evil.top/x", False, False, False, True, False), (1, 1, "https://bit.ly/q", False, False, False, False, False), (1, 2, "https://bank.com/", False, False, True, False, True), (1, 3, "https://docs.google.com/forms/1", True, False, False, False, False), (1, 4, "http://printer.lan/", False, False, False, False, False), (2, 0, "http://c.top/", False, False, False, False, False)]
    found = scoring.indicators(scoring.indicator_rows(mail, spark.createDataFrame(links, kinds))).collect()
    assert {(r.msg_id, r.type, r.value) for r in found} == {(1, "url", "http://a.evil.top/x"), (1, "domain", "a.evil.top"), (1, "url", "https://bit.ly/q"), (1, "url", "https://docs.google.com/forms/1"), (1, "email", "x@evil.top"), (1, "domain", "evil.top"), (1, "email", "y@gmail.com"), (1, "ipv4", "9.9.9.9")}


def test_headers_of_mail_reach_authentication_and_rules(spark, tmp_path):
    from pyspark.sql import functions as F

    from lurescope.functions.auth import authentication

    folded = "Authentication-Results: mx.our.example;\r\n spf=pass smtp.mailfrom=a.net;\r\n dmarc=fail header.from=b.net\r\nReturn-Path: <U@a.net>\r\n"
    encoded = "Authentication-Results: =?utf-8?B?bXguZXg7IHNwZj1mYWls?=\r\n"
    for name, head in (("a", folded), ("b", encoded), ("c", "")):
        (tmp_path / f"{name}.eml").write_bytes((head + "From: x@b.net\r\nSubject: s\r\n\r\ntext\r\n").encode())
    found = parse_mail(read_mail(spark, str(tmp_path))).withColumn("auth", authentication(F.col("headers"))).orderBy("path")
    rows = found.select("return_path", "auth.spf", "auth.dmarc", "auth.receiver", F.col("auth.checks.domain").alias("domains")).collect()
    assert [tuple(r) for r in rows] == [("u@a.net", "pass", "fail", "mx.our.example", ["a.net", "b.net"]), (None, "fail", None, "mx.ex", [""]), (None, None, None, "", [])]


def test_from_mail_to_signals(spark, tmp_path):
    from lurescope.operators import catalogue
    from lurescope.operators.facts import message_facts

    forged = "Authentication-Results: mx.ex; spf=fail smtp.mailfrom=a.net\r\nX: y\r\nAuthentication-Results: mx.ex; dkim=pass\r\nAuthentication-Results: up.ex; dmarc=pass\r\nReply-To: z@other.org\r\n"
    for name, head, text in (("a", forged, "Pay to 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa, see http://a.net/x"), ("b", "", "plain"), ("c", "", "x" * 900)):
        (tmp_path / f"{name}.eml").write_bytes(f"{head}From: u@mail.a.net\r\nSubject: {name}\r\n\r\n{text}\r\n".encode())
    facts = message_facts(parse_mail(read_mail(spark, str(tmp_path), 600))).cache()
    rows = {r.subject: r for r in facts.collect()}
    assert set(rows) == {"a", "b"}  # c is over the limit, so that it is an error row
    assert (rows["a"].from_base, rows["a"].reply_base, rows["a"].n_urls, rows["a"].auth_seen) == ("a.net", "other.org", 1, True)
    assert (rows["b"].forged_claims, rows["b"].wallets, rows["b"].auth_seen, rows["b"].spf) == ([], [], False, None)
    found = catalogue.signals(facts, "message").join(facts.select("msg_id", "subject"), "msg_id").collect()
    labels = {(r.subject, r["rule"]): r["label"] for r in found}
    assert {rule for subject, rule in labels if subject == "a"} == {2, 3, 4, 10, 79}
    assert labels["a", 79] == "bitcoin wallet address in the message" and not any(subject == "b" for subject, _ in labels)
    facts.unpersist()
