"""Operators against brute force, round trips and odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lurescope.llm import bpe, chat, classifier, exact, html, neardup, packing, rules, spans, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "no key here at all"), (1, None), (2, ""), (3, " \n "), (4, "One two three."), (5, "one TWO three."), (5, "one TWO three."), (6, "É" * 40), (7, "word " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, None, None, None) for k, t in ODD], DOCS).withColumn("kept", F.lit(1)).withColumn("digest", F.lit("x"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_grace_partitions_compare_contents():
    rng = random.Random(1)
    records = [(bytes(rng.choices(b"ab", k=rng.randint(0, 9))), i) for i in range(3000)]
    expected = {}
    for content, i in records:
        expected.setdefault(content, []).append(i)
    for limit, hashed in ((1 << 30, None), (2000, None), (2000, lambda c: 7)):
        got = exact.grace(iter(records), limit, **({"hashed": hashed} if hashed else {}))
        assert {c: sorted(p) for c, p in got} == expected


def test_exact_groups_on_odd_rows(odd, empty):
    rows = exact.exact_groups(odd).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.text_sha256): r for r in rows}
    assert by[4, hashlib.sha256(b"one two three.").hexdigest()].keep_id == 5
    assert sum(r.kept for r in rows if r.keep_id == 5) == 1 and {r.group_size for r in rows if r.keep_id == 5} == {3}
    assert [r.kept for r in rows if r.doc_id is None] == [True]
    assert sorted(r.doc_id or 0 for r in exact.exact_dedup(odd).select("doc_id").collect()) == [0, 2, 3, 5, 6, 7]
    assert exact.exact_groups(empty).count() == exact.exact_dedup(empty).count() == 0


def _sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_near_groups_equal_all_pairs(spark, docs):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        near.append((10_000 + i, " ".join(w)))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + near + [(20_000, ""), (20_001, None), (20_002, "a b"), (20_003, "A  b")]
    sets = {k: _sets(t, 4) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    found = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found} == {(k, len(s), find(k), find(k) == k) for k, s in sets.items()}


def test_near_groups_in_blocks_without_pivots(spark, monkeypatch):
    """With no tie made before, the block pass alone finds a chain's links."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    w = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(w[i * 4 : i * 4 + 60])) for i in range(10)]
    found = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()
    assert {r.component_id for r in found} == {0}


def test_near_groups_on_odd_rows(odd, empty):
    rows = neardup.near_groups(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert neardup.near_groups(empty).count() == 0 and neardup.near_dedup(odd).columns == odd.columns


def test_near_groups_with_repeated_and_null_keys(spark):
    a, b = ([f"{c}{i}" for i in range(100)] for c in "ab")
    a1, a2, b1, b2 = (" ".join(w) for w in (a, [*a, "x"], b, [*b, "x"]))
    rows = [(7, a1), (None, a1), (3, a1), (7, b1), (8, b2), (9, a2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = neardup.near_groups(frame).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in found) == Counter([(7, 3, False), (None, 3, False), (3, 3, True), (7, 7, True), (8, 7, False), (9, 3, False)])
    assert sorted((r.doc_id, r.text) for r in neardup.near_dedup(frame).collect()) == [(3, a1), (7, b1)]


def test_spans_remove_later_copies(spark, odd, empty):
    passage = "The first of these sentences has quite some words. The second one follows it closely enough. A third one ends the long passage here."
    rows = [(1, f"Unique opening here. {passage} Unique end."), (2, f"Other opening.\n{passage}\nOther end."), (3, "Short. Short. Short. Short.")]
    out = {r.doc_id: r for r in spans.span_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(0)), count="n").collect()}
    assert out[1].text == rows[0][1] and out[3].text == rows[2][1]
    assert out[2].text == "Other opening.\nOther end." and out[2].n == len(out[2].text)
    assert spans.span_dedup(odd).count() == len(ODD) and spans.span_dedup(empty).count() == 0


def test_spans_of_short_sentences_and_without_edge_sentences(spark):
    verse = " ".join(f"W{i}!!" for i in range(60))
    first, second, third = (" ".join(f"{c}{i}" for i in range(n)) + "." for c, n in (("a", 31), ("b", 6), ("c", 16)))
    rows = [(1, f"{verse} End."), (2, f"Other start. {verse}"), (3, f"{first} {second} {third}"), (4, f"Starts inside: {first} {second} {third} Next.")]
    out = {r.doc_id: r.text for r in spans.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "Other start.", 3: rows[2][1], 4: f"Starts inside: {first} Next."}
    rng = random.Random(9)
    for _ in range(300):
        counts = rng.choices([1, 2, 3, 9, 10, 19, 20, 30], k=rng.randint(0, 12))
        found = spans.places(counts)
        for a, b in itertools.combinations(range(len(counts) + 1), 2):
            whole = sum(counts[a:b]) >= 20 or sum(counts[a:b]) >= 10 and b - a >= 3
            assert {i for x, y in found if a <= x and y <= b for i in range(x, y)} == (set(range(a, b)) if whole else set())


def test_chat_round_trip_and_masks(spark):
    rng = random.Random(3)
    parts = ["\\", "<", "|", "</s>", "[INST]", "b", "l", "n", "\n", "<|im_end|>", "é"]
    turns = [(c, t, rng.choice(["user", "assistant", None, "odd\nrole"]), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for c in range(20) for t in range(rng.randint(1, 6))]
    turns += [(50, 0, "assistant", None), (None, 0, "user", "x"), (51, 1, "assistant", "a"), (51, 1, "assistant", "a"), (51, None, "user", "z" * 300_000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1))
    found = [r.asDict() for r in chat.examples(frame).collect()]
    assert not any("[INST]" in r["text"] or "</s>" in r["text"] for r in found)
    rows = {r.conv_id: r for r in chat.digests(frame).collect()}
    for c in {t[0] for t in turns}:
        mine = [(r or "", t or "") for k, o, r, t in sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))]
        targets = [i for i, (r, _) in enumerate(mine) if r == "assistant"]
        examples = sorted((r for r in found if r["conv_id"] == c and r["target_turn"] is not None), key=lambda r: r["target_turn"])
        assert [r["target_turn"] for r in examples] == targets
        for r in examples:
            assert list(chat.parse(r["text"])) == mine[: r["target_turn"] + 1]
            assert chat.unescape(r["text"][r["loss_start"] : r["loss_end"]]) == mine[r["target_turn"]][1]
        rest = [r for r in found if r["conv_id"] == c and r["target_turn"] is None]
        assert len(rest) == (mine[-1][0] != "assistant") and all(list(chat.parse(r["text"])) == mine and r["loss_start"] is None for r in rest)
        loss = "".join(t for r, t in mine if r == "assistant")
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (rows[c].loss_chars, rows[c].loss_sha256, rows[c].n_turns) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(mine))
        assert rows[c].formatted_chars == sum(len(r["text"]) for r in examples)
    assert chat.digests(frame.limit(0)).count() == chat.examples(frame.limit(0)).count() == 0


def test_statistics_equal_a_plain_count(spark):
    rng = random.Random(4)
    texts = ["", None, "a", "a b a b a b", "x\nx\n \n\nx y"] + ["".join(rng.choices(["a", "b", " ", "\n", "#", "é", "\t", ".", "A"], k=rng.randint(0, 60))) for _ in range(200)]
    rows = rules.text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        w = text.encode().split()
        runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if line.encode().split()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_decision_list_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    counted = rules.text_statistics(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    learned = rules.learn(rules.labelled_sample(counted, labels.where("doc_id % 2 = 0")))
    held = rules.judged(counted, learned).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    clean, bad = held[(held.quality == 1) & ~held.base_failed], held[held.quality == 0]
    assert learned and clean.kept.mean() > 0.99 and (~bad.kept).mean() > 0.85
    assert rules.judged(counted.limit(0), []).count() == 0


def test_packing_places_every_piece_once(docs, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for frame in (docs, odd):
        rows = packing.best_fit_pack(frame, path).toPandas().sort_values(["sequence_id", "offset"])
        ends = rows.groupby("sequence_id")["length"].cumsum()
        assert (rows["offset"] == ends - rows["length"]).all() and ends.max() <= 1024
    assert packing.best_fit_pack(empty, path).count() == 0
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    found = {(r.doc_id, r.piece): r for r in packing.pieces(docs, path).collect()}
    for r in docs.limit(40).collect():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        at, n = 0, 0
        while at < len(ids):
            step = (len(ids) - at) % 1024 or 1024
            assert found[r.doc_id, n].ids_crc32 == zlib.crc32(np.array(ids[at : at + step], "<u4").tobytes())
            at, n = at + step, n + 1


def test_encoder_equals_the_library_on_tokens_and_odd_spaces():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = ["", "  a", "a  b", " ", "x ", "\n x\t y", "don't  <|endoftext|>", "a b \x1c c"] + ["".join(rng.choices(["a", " ", "\n", "b", "\t", "1", "é", ".", "'s"], k=rng.randint(0, 14))) for _ in range(3000)]
    texts += [t.decode() for t in packing._ranks(path) if t.decode("utf-8", "ignore").encode() == t]
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert packing.encoded(path, texts) == expected


def test_added_tokens_get_the_ids_that_the_library_gives(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(10)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y", "<|endoftext|", "plain"]
    texts += ["".join(rng.choices(["<|endoftext|>", "a", " ", "\n", "<|", "'s", "é"], k=rng.randint(0, 12))) for _ in range(500)]
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert expected[0] == np.array([64, 220, 50256, 275], "<u4").tobytes()
    rows = {r.doc_id: r for r in packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    end = np.array([2], "<u4").tobytes()
    assert [(rows[i].length, rows[i].ids_crc32) for i in range(len(texts))] == [(len(ids) // 4 + 1, zlib.crc32(ids + end)) for ids in expected]


def test_plan_uses_all_counts_and_exact_complements():
    rng = random.Random(6)
    for _ in range(20):
        counts = Counter(rng.choices(range(1, 1025), k=rng.choice([1, 5, 50, 3000])))
        used = Counter()
        for lengths, times in packing.plan(counts):
            assert sum(lengths) <= 1024 and times > 0
            for n in lengths:
                used[n] += times
        assert used == counts
    assert packing.plan({700: 2, 324: 2, 500: 1, 400: 1, 124: 1}) == [((700, 324), 2), ((500, 400, 124), 1)]


def test_bpe_equals_tiktoken(odd, empty, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for frame in (odd, docs.limit(60)):
        texts = [r.text or "" for r in frame.collect()]
        rows = bpe.bpe(frame, path, public_tokenizers.PATTERN).collect()
        assert sorted((r.n_tokens, bytes(r.decoded)) for r in rows) == sorted((len(known.encode_ordinary(t)), t.encode()) for t in texts)
        assert {r.ids_sha256 for r in rows} == {hashlib.sha256(np.array(known.encode_ordinary(t), "<u4").tobytes()).hexdigest() for t in texts}
    assert bpe.bpe(empty, path, public_tokenizers.PATTERN).count() == 0
    for word in (b"x" * 3000, b"ab" * 900, "thanéber".encode() * 200):
        assert bpe.contract_long(word, bpe.load_ranks(path)) == known.encode_ordinary(word.decode())


def test_archive_round_trip(spark):
    body = "<p>" + "é" * 100
    pages = [(3, "http://a/\r\nx", body), (1, None, body), (1, None, body), (None, "u", body), (4, "v", "short"), (5, "v", "short"), (6, "w", None)]
    path = warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1))
    records = warc.parse_records(warc.read_archive(spark, path)).collect()
    assert len(records) == 7 and all(len(r.block) == r.content_length for r in records)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    rows = warc.archive_report(spark, path).collect()
    found = Counter((r.page_id, r.record_type, r.refers_to) for r in rows)
    assert found == Counter([(None, "revisit", 1), (1, "response", None), (1, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None)])
    assert {r.payload_digest for r in rows} == {hashlib.sha256((h or "").encode()).hexdigest() for *_, h in pages}


def test_html_main_text_and_boilerplate(spark):
    page = "<html><body><nav>Menu</nav><article><h1>Title &amp; more</h1><p>One\n two<br>three<p>Four <b>five</b>&nbsp;x</article><div class='ad'>Buy</div></body>"
    bar = "<div>Welcome to our site where all the same words stand on each page</div>"
    pages = [(1, "http://h/1", page), (2, "http://h/2", None), (3, "http://h/3", ""), (4, "http://h/4", f"{bar}<p>Unique text of the fourth page is here</p>"), (5, "http://h/5", f"{bar}<p>Another text stands on the fifth page</p>"), (6, None, f"{bar}<p>On another host nothing is repeated</p>")]
    out = {r.page_id: r for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[1].text == "Title & more\nOne two three\nFour five x" and out[1].n_chars == len(out[1].text)
    assert out[2].text == out[3].text == ""
    assert out[4].text == "Unique text of the fourth page is here" and out[5].text == "Another text stands on the fifth page"
    assert out[6].text.startswith("Welcome")


def _brute_texts(pages, depth=8):
    """The module's rules on (key, host, main, blocks), by sets of runs."""
    stream = lambda blocks: [t for b in blocks for t in ("\x1e", *b.split(" "))]
    distinct = {(h, m, tuple(b)) for _, h, m, b in pages}
    on, total = {}, Counter(h for h, _, _ in distinct)
    for page in distinct:
        t = stream(page[2])
        for i in range(len(t) - depth + 1):
            on.setdefault((page[0], tuple(t[i : i + depth])), set()).add(page)
    out = {}
    for key, h, m, blocks in pages:
        t, covered, at, kept = stream(blocks), set(), 0, []
        for i in range(len(t) - depth + 1):
            n = len(on[h, tuple(t[i : i + depth])])
            if n >= 2 and (not m or n >= html.SITE_PAGES and n >= html.SITE_SHARE * total[h]):
                covered.update(range(i, i + depth))
        for b in blocks:
            n = len(b.split(" "))
            if 2 * len(covered & set(range(at + 1, at + 1 + n))) <= n:
                kept.append(b)
            at += n + 1
        out[key] = "\n".join(kept)
    return out


@pytest.mark.parametrize("unit", [2000, 40])
def test_suffix_array_judges_blocks_in_and_outside_articles(spark, monkeypatch, unit):
    """Whole texts against brute force, with hosts in one unit and in several."""
    monkeypatch.setattr(html, "SHARD_PAGES", unit)
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    bars, quote, site = [words(12) for _ in range(4)], words(20), words(15)
    pages = []
    for key in range(300):
        host, main = key % 3, key % 3 < 2
        blocks = [words(rng.randint(1, 30)) for _ in range(rng.randint(1, 3))]
        if not main:
            blocks.append(rng.choice(bars))
        elif rng.random() < 0.5:
            blocks.insert(0, quote)  # articles quote each other
        if host == 0:
            blocks.append(site)  # and on one host, each ends in the same words
        pages.append((key, host, main, blocks))
    pages += [(1000 + i, *pages[0][1:]) for i in range(5)]  # copies
    page = lambda main, blocks: "<body>" + ("<article>" if main else "<div>") + "".join(f"<p>{b}</p>" for b in blocks) + "</body>"
    frame = spark.createDataFrame([(k, f"https://h{h}.net/{k}", page(m, b), 1, "x") for k, h, m, b in pages], "page_id long, url string, html string, host long, unit string")
    found = {r.page_id: r.text for r in html.main_text(frame).collect()}
    expected = _brute_texts(pages)
    assert found == expected
    assert site not in found[0] and all(quote in found[k] for k, h, m, b in pages if m and quote in b)
    assert html.main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("unit", "chars"), [(2000, 32 << 20), (5, 32 << 20), (60, 1500), (5, 700)])
def test_texts_do_not_depend_on_how_pages_are_dealt(spark, monkeypatch, unit, chars):
    """Whole texts against brute force, with hosts in one unit, in many small ones, and in units that are cut."""
    monkeypatch.setattr(html, "SHARD_PAGES", unit)
    monkeypatch.setattr(html, "UNIT_CHARS", chars)
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    sites, once, copied = [words(12) for _ in range(6)], words(12), [words(40)]
    pages = []
    for key in range(120):  # articles with site-wide blocks, some on just as many pages as it takes or on one less
        ends = [s for i, s in enumerate(sites) if key % 40 >= i + 1 or key >= 80 and i < 3]
        pages.append((key, 0, True, [words(rng.randint(5, 30)), *ends]))
    for key in range(200, 260):  # articles, one of which shares a block with the host's only page without a main part
        pages.append((key, 1, key != 230, [words(rng.randint(5, 30)), *[once] * (key in (230, 250))]))
    for key in range(300, 340):  # copies of one page, and others without a main part
        pages.append((key, 2, False, copied if key % 2 else [words(rng.randint(5, 30))]))
    page = lambda main, blocks: "<body>" + ("<article>" if main else "<div>") + "".join(f"<p>{b}</p>" for b in blocks) + "</body>"
    frame = spark.createDataFrame([(k, f"https://h{h}.net/{k}", page(m, b)) for k, h, m, b in pages], "page_id long, url string, html string").repartition(8)
    found = {r.page_id: r.text for r in html.main_text(frame).collect()}
    assert found == _brute_texts(pages)
    assert once not in found[230] and once in found[250] and found[301] == found[303] == copied[0]


def test_filters_hold_the_runs_of_their_host():
    texts = [[" ".join(f"{a}{b}\u00e9{i}" for i in range(40)) for b in "xy"] for a in "pqr"]
    pages = [(-5, 1, False, texts[0]), (7, 2, False, texts[1]), (-5, 3, False, texts[2]), (9, 4, False, []), (11, 5, False, texts[0])]
    words = list(html.filters(pages))
    made = html.Unit(pages)
    assert {w["host"] for w in words} == {-5, 7, 11} and made.hosts.tolist() == [-5, 7, 9, 11]
    for host in (-5, 7, 11):
        own = [w for w in words if w["host"] == host]
        held = html.may_hold(html.press_filter([w["slot"] for w in own], [w["bits"] for w in own]), made.code)
        assert held[made.hosts[made.host] == host].all() and held.sum() <= (made.hosts[made.host] == host).sum() + 5
    assert html.press_filter(list(range(html.FILTER // 64)), [-1] * (html.FILTER // 64)) == b"" and html.may_hold(b"", made.code).all()


def test_html_odd_markup():
    text = lambda body: "|".join(html.candidates(body)[1])
    assert text("<p>a</p><!--><p>shown</p><!-- x --!>y<!--->z") == "a|shown|y|z" or text("<p>a</p><!--><p>shown</p>") == "a|shown"
    for name in ("entry-comments", "comment-content", "story-newsletter", "related-post", "ad top"):
        assert text(f"<article><p>a</p><div class='{name}'>b</div></article>") == "a"
    for name in ("has-sidebar", "content-sidebar-wrap", "no-comments", "post-header"):
        assert text(f"<div class='{name}'><p>a</p></div>") == "a"
    assert text("<article><header><h1>Title</h1></header><p>a</p><footer>b</footer></article>") == "Title|a"
    assert text("<header>site</header><p>a</p>") == "a"
    for tag in ("textarea", "title", "select"):
        assert "shown" in text(f"<div><p>a</p><{tag}>b</div><p>shown</p>")
    assert text("<article><p>" + "x" * 300_000 + "</article>") == "x" * 300_000


def test_model_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("abracadabra alakazam",), ("banana bandana",), ("",), (None,)], "t string")
    model, unseen = classifier.kneser_ney(texts)
    known = {r.gram: (r.alpha or 0.0, 1.0 if r.gamma is None else r.gamma) for r in model.collect()}
    letters = {g for g in known if len(g) == 1} - {"\x02"}  # which is only ever a context
    for context in ("ban", "zzz", "abr", "\x02\x02a"):
        total = sum(np.exp(classifier.log_probability(context + c, known, unseen)) for c in letters)
        rest = np.exp(classifier.log_probability(context + "☃", known, unseen))
        assert total + rest == pytest.approx(1, abs=1e-4)


def test_classifier_on_odd_rows_and_without_labels(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, None), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    rows = classifier.judged(odd, labels).collect()
    assert len(rows) == len(ODD) and {r.kept for r in rows if r.doc_id in (1, 2)} == {False}
    assert classifier.judged(odd, labels.limit(0)).where("kept").count() == len(ODD) - 2
    assert classifier.judged(empty, labels).count() == 0 and classifier.quality_filter(odd, labels).columns == odd.columns


def test_classifier_rejects_labelled_bad_documents_at_a_stated_loss(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trusted = classifier.trusted_keys(labels).withColumn("held", classifier._fold("trusted") == 0)
    rows = classifier.judged(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").join(trusted, F.col("doc_id") == F.col("trusted"), "left").toPandas()
    good = rows[rows["held"].notna()]
    assert rows[rows["quality"] == 0].kept.mean() < 0.05
    assert good.kept.mean() > 0.99 and good[good["held"].astype(bool)].kept.mean() > 0.985


def test_log_perplexities_equal_brute_force(spark):
    """Interpolated modified Kneser-Ney written plainly over dictionaries."""
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcdé ", weights=[9, 5, 3, 2, 1, 4], k=rng.randint(1, 80))) for _ in range(60)]
    pad, order = "\x02", classifier.ORDER
    occurs = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        padded = pad * (order - 1) + t
        for i in range(order - 1, len(padded)):
            for k in occurs:
                occurs[k][padded[i - k + 1 : i + 1]] += 1
    counts = {order: occurs[order]}
    for k in range(1, order):
        left = Counter(g[1:] for g in occurs[k + 1])
        counts[k] = {g: n if g[0] == pad else left[g] for g, n in occurs[k].items()}
    alpha, gamma = {}, {}
    for k, table in counts.items():
        n = [sum(c == i for c in table.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        d = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0), i + 1) for i in range(3)] if all(n) else [0.5, 1.0, 1.5]
        total, mass = Counter(), Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3) - 1]
        alpha |= {g: max(c - d[min(c, 3) - 1], 0) / total[g[:-1]] for g, c in table.items()}
        gamma |= {ctx: min(mass[ctx] / total[ctx], 1) for ctx in total}

    def log_perplexity(t):
        padded, out = pad * (order - 1) + t, 0
        for i in range(order - 1, len(padded)):
            p = 1 / (len(counts[1]) + 1)
            for k in range(1, order + 1):
                g = padded[i - k + 1 : i + 1]
                p = alpha.get(g, 0) + gamma.get(g[:-1], 1) * p
            out -= np.log(p)
        return out / len(t)

    model, unseen = classifier.kneser_ney(spark.createDataFrame([(t,) for t in texts], "t string"))
    others = texts + ["zz", "abba cab", "é", "a" * 5000]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(others)], "doc_id long, text string, lang string")
    rows = classifier.scores(frame, model, unseen).collect()
    assert len(rows) == len(others) and all(r.log_ppl == pytest.approx(log_perplexity(others[r.doc_id]), abs=1e-4) for r in rows)


def _clashing(frame):
    names = "_key _code _drop _digest _again _slice gone_key gone_code span_key span_code span_drop exact_code exact_again rules_label pack_slice pack_before"
    for name in names.split():
        frame = frame.withColumn(name, F.lit(name))
    return frame


def test_columns_that_clash_with_helpers_stay(spark, odd):
    frame = _clashing(odd)
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    for work in (exact.exact_dedup, neardup.near_dedup, spans.span_dedup, lambda d: classifier.quality_filter(d, labels)):
        out, plain = work(frame), work(odd)
        assert out.columns == frame.columns and sorted(map(str, out.select(odd.columns).collect())) == sorted(map(str, plain.collect()))
        assert out.where("_key <> '_key' OR gone_code <> 'gone_code' OR _drop <> '_drop'").count() == 0
    found = _clashing(packing.pieces(odd, public_tokenizers.path("byte_bpe_50k.json")))
    assert packing.pack(found).columns == [*found.columns, "sequence_id", "offset"]


def test_bpe_of_long_texts_in_parts(spark, monkeypatch):
    import tiktoken

    from lurescope.llm import chunked

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(13)
    texts = ["".join(rng.choices(["a", "bc", " ", "\n", "é", "\t", "7", "'s", "!", "日本"], k=rng.randint(0, 60))) for _ in range(300)]
    texts += [" ".join("".join(rng.choices("abcdef", k=n)) for _ in range(3)) for n in (127, 128, 129, 600)]
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 7)
    monkeypatch.setattr(bpe, "QUERY_ROWS", 5000)
    monkeypatch.setattr(chunked, "SEGMENT", 5)
    worker = bpe.Codec(path, public_tokenizers.PATTERN)
    encoded = worker.encode(texts)
    assert [np.frombuffer(e, "<u4").tolist() for e in encoded] == [known.encode_ordinary(t) for t in texts]
    assert worker.decode(encoded) == [t.encode() for t in texts]
    monkeypatch.undo()
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(600_000))
    frame = _clashing(spark.createDataFrame([(1, long)], "doc_id long, text string"))
    (row,) = bpe.bpe(frame, path, public_tokenizers.PATTERN, arrays=False).collect()
    assert row.decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() and row.n_tokens == len(known.encode_ordinary(long))


def test_learning_without_labels_and_a_bounded_sample(spark, odd, empty):
    counted = rules.text_statistics(odd)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.learn(rules.labelled_sample(counted, none)) == []
    assert rules.judged(counted, []).where("kept").count() == 0 and rules.text_statistics(empty).count() == 0
    many = spark.range(0, 5000, 1, 40).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert len(rules.labelled_sample(rules.text_statistics(many), labels, rows=300)) == 300


def test_archive_of_odd_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_report(spark, warc.write_archive(none)).count() == 0
    rows = [(i % 7, "u", "<p>" + "x" * 200_000) for i in range(30)] + [(i, "u", "") for i in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).withColumn("digest", F.lit(1)).withColumn("row", F.lit(2))
    path = warc.write_archive(frame)
    found = warc.archive_report(spark, path).collect()
    assert len(found) == 60 and spark.read.parquet(f"{path}/payloads").count() == 2
    assert Counter((r.record_type, r.refers_to) for r in found) == Counter({("response", None): 31, ("revisit", 0): 29})
