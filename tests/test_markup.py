"""Markup, links and files of mail: from raw messages to signals."""

import time
from email.message import EmailMessage

import pytest

from lurescope.operators import catalogue, facts, links
from lurescope.sources.mail import parse_mail, read_mail
from lurescope.sources.markup import shown, tokens

BODY = """<p>Mic<span style="display:none">zz</span>ros<i hidden>q</i>oft</p><a href="https://www.google.com/url?q=https%3A%2F%2Fevil.top%2Fsetup.exe">www.bank.com</a>
<a href="https://na01.safelinks.protection.outlook.com/?url=http%3A%2F%2F10.2.3.4%2Fx">ok</a><img src="https://cdn.net/p.png"><a href="javascript:go()">z</a><a href="mailto:x@y.z">m</a>
<div hidden>This message is a safe email, not spam.</div>"""
PAGE = b"<html><form><input type=password></form><script>atob('aHR0cDovL2EubmV0L3g='); eval(1); location.href='http://r.net/'</script>"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mail")
    message = EmailMessage()
    message["From"] = "A <a@b.net>"
    message.set_content("See hxxp://one[.]net/a and http://one.net/A/ now")
    message.add_alternative(BODY, subtype="html")
    message.add_attachment(PAGE, maintype="text", subtype="html", filename="f.html")
    message.add_attachment(b"{\\rtf \\objclass htmlfile}", maintype="application", subtype="rtf", filename="x.rtf")
    for copy in "ab":  # the same message twice
        (folder / f"{copy}.eml").write_bytes(bytes(message))
    plain = EmailMessage()
    plain["From"] = "q@r.net"
    plain.set_content("nothing")
    (folder / "c.eml").write_bytes(bytes(plain))
    many = EmailMessage()
    many["From"] = "q@r.net"
    many.set_content("\n".join(f"http://host{i}.net/" for i in [*range(1003), 1002, 0]))
    (folder / "d.eml").write_bytes(bytes(many))
    return read_mail(spark, str(folder))


def rules(rows, grain):
    return sorted({(r.rule, r.severity) for r in catalogue.signals(rows, grain).collect()})


def test_links_of_messages(files):
    found = links.message_links(parse_mail(files))
    few = {r.url: r for r in found.collect() if not r.host.startswith("host")}
    assert {u: (r.sources, r.redirect_to, r.n, r.place) for u, r in few.items()} == {
        "http://one.net/a": (["body-text"], "", 2, 1),
        "https://www.google.com/url?q=https%3A%2F%2Fevil.top%2Fsetup.exe": (["html-href"], "https://evil.top/setup.exe", 1, 2),
        "https://evil.top/setup.exe": (["redirect target (Google redirect)"], "", 1, 3),
        "http://10.2.3.4/x": (["html-href via Microsoft Safe Links"], "", 1, 4),
        "https://cdn.net/p.png": (["html-resource"], "", 1, 5),
        "http://www.bank.com": (["html-text"], "", 1, 6),
    }
    assert found.where("place > 1000").count() == 3
    assert [(r.urls_dropped, r.urls_checked) for r in links.dropped_links(found).collect()] == [(4, 1000)]
    judged = links.link_facts(found).where("url NOT LIKE 'http://host%'")
    assert rules(judged, "link") == [(24, "high"), (25, "high"), (29, "low"), (32, "medium"), (33, "medium")]
    assert rules(links.script_links(parse_mail(files)), "link") == [(74, "medium")]


def test_facts_of_messages_and_files(spark, files):
    mail = parse_mail(files)
    held = facts.message_facts(mail)
    assert {r.n_urls for r in held.collect()} == {5, 0, 1003}
    assert rules(held, "message") == [(69, "high"), (73, "medium")]
    assert rules(facts.attachment_facts(files), "file") == [(36, "high"), (56, "high"), (62, "high"), (63, "high"), (64, "medium")]
    assert facts.message_facts(mail.limit(0)).count() == links.message_links(mail.limit(0)).count() == facts.attachment_facts(files.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<p ", "<p a='", "<", "<!--", "</", "<script>", "<a b=c ", "<div>", "</b>", "&amp", "<style>.a{", "<b hidden>x", "﷐﷑a"])
def test_odd_markup_takes_time_in_proportion(piece):
    began = time.process_time()
    shown(piece * 100_000)
    assert time.process_time() - began < 20


def test_tokens():
    assert list(tokens("a<B x=1 y='2' Z=\"&lt;\" x=3/>b</b >c<!--d-->e<?f>g<h")) == [
        ("text", "a", {}), ("start", "b", {"x": "1", "y": "2", "z": "<"}), ("text", "b", {}), ("end", "b", {}), ("text", "c", {}), ("text", "e", {}), ("text", "g", {}), ("text", "<h", {}),
    ]
    assert list(tokens("<br/><script>a</b></Script >c")) == [("empty", "br", {}), ("start", "script", {}), ("raw", "a</b>", {}), ("end", "script", {}), ("text", "c", {})]
