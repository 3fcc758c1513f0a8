"""Main text of web pages, with a suffix array over each host's pages.

A page is parsed into blocks of text, each with what the markup says of it: in the main part (``article`` or ``main``),
outside it, or in an element that is never content (menus, headers, footers, sidebars, notices, adverts, forms,
comments). The blocks of the main part or, where no part is marked, those outside are the page's candidates, and their
tokens are its stream.

The streams of a host's pages are concatenated in a suffix array, sorted to a depth of ``DEPTH`` tokens, which brings
equal substrings together. A substring on two distinct pages is repeated, one on at least SITE_PAGES pages and SITE_SHARE
of the host's is site-wide. Of candidates that markup doesn't vouch for, those covered mostly by repeated substrings go;
of those in a main part, where articles may quote each other, those covered mostly by site-wide ones. The rest stays.

Equal streams of a host count as one page, so that copies don't make each other boilerplate.

A host's pages are dealt to units of about SHARD_PAGES pages by a hash of their streams, and a unit of more than UNIT_CHARS
characters is cut, so that a large host is many units. Each unit has an array of its own. What it counts is final for hosts
that are in it as a whole; for others, counts are summed over units. Texts don't depend on how pages are dealt:

- Equal streams meet in one unit, and where that is cut, the first of its units counts them.
- Runs of a host's pages without a main part set places in a filter of FILTER bits. All units tell the counts of runs
  that may be in it.
- Of other runs only site-wide ones matter. Each unit tells its runs on half of SITE_SHARE of its own pages; a run that is
  site-wide is told by one unit at least. With the most that the other units can have untold, nearly all of these runs are
  decided; what is still open is looked up in those units.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.functions.text import raw_host
from lurescope.llm.textops import WordHashes, map_rows, windows
from lurescope.runtime import small, staged

#: Tokens of a substring that counts as repeated; pages of a unit, and characters after which it is cut in two.
DEPTH, SHARD_PAGES, UNIT_CHARS = 8, 2000, 32 << 20
#: Pages, and share of a host's pages, that a site-wide substring is on at least.
SITE_PAGES, SITE_SHARE = 20, 0.9
#: Bits of a host's filter; where more than half are set, the filter holds everything. This bounds work, not results.
FILTER = 1 << 18

#: Elements whose content is not text; UNCLOSED ones take the rest of the page where they aren't closed.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video title textarea".split())
UNCLOSED = frozenset(("script", "style"))
#: Elements that are never part of the article, but for a header within it, which has its title.
ASIDE = frozenset("nav header footer aside form button dialog menu head select".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
#: Names in class, id or role that say the same of other elements.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination paywall "
    "popup promo promoted promotion recommended related reply replies search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription taboola toolbar widget".split()
)
#: Names that say nothing beside one of CONTENT_NAMES, as in post-header.
WEAK_NAMES = frozenset("banner header search".split())
CONTENT_NAMES = frozenset("article content entry main post story".split())
#: A name with one of these is about the layout of what it encloses, as in content-sidebar-wrap or has-sidebar.
LAYOUT_NAMES = frozenset("body container grid has layout no page row with without wrap wrapper".split())

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ROLE_MAIN = re.compile(r"""\brole\s*=\s*["']?main\b|\bitemprop\s*=\s*["']?articleBody\b""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|\baria-hidden\s*=\s*["']?true""", re.I)

OUTSIDE, MAIN, NEVER = 0, 1, 2


def _never(tag: str, attributes: str, place: int) -> bool:
    if tag in ASIDE:
        return tag != "header" or place != MAIN
    if not attributes or tag in ("html", "body"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for found in _NAMES.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            words = set(re.split(r"[^a-z0-9]+", name))
            weak = WEAK_NAMES if place == MAIN or words & CONTENT_NAMES else frozenset()
            if words & ASIDE_NAMES - weak and not words & LAYOUT_NAMES:
                return True
    return False


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(place, text) of each block with text, in page order; place is OUTSIDE, MAIN or NEVER.

    Character references are decoded, white space is one space, ends are trimmed.
    """
    html = html or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    place, at, end = OUTSIDE, 0, len(html)

    def flush() -> None:
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                out.append((place, text))
            parts.clear()

    while at < end:
        tag = html.find("<", at)
        if tag < 0:
            parts.append(html[at:])
            break
        found = _TOKEN.match(html, tag)
        if not found:
            parts.append(html[at : tag + 1].replace("<", "&lt;") if html[tag] == "<" else html[at : tag + 1])
            at = tag + 1
            continue
        parts.append(html[at:tag])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                parts.append(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        closes, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if name in RAW and not closes:
            if not attributes.endswith("/") or name not in ("svg", "math"):
                stop = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(html, at)
                at = stop.end() if stop else end if name in UNCLOSED else at
            if name in BLOCK:
                flush()
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if place != stack[i][1]:
                        flush()
                    place = stack[i][1]
                    del stack[i:]
                    break
            continue
        if name in BLOCK and stack and name != "p" or name == "p":
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends where a block begins
                if stack[i][0] == "p":
                    place = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        stack.append((name, place))
        if place != NEVER:
            now = NEVER if _never(name, attributes, place) else MAIN if name in ("article", "main") or _ROLE_MAIN.search(attributes) else place
            if now != place:
                flush()
                place = now
    flush()
    return out


def candidates(html: str | None) -> tuple[bool, list[str]]:
    """Whether the page marks a main part, and the text of each block in it, or outside it if there is none."""
    found = blocks(html)
    main = any(where == MAIN for where, _ in found)
    return main, [text for where, text in found if where == (MAIN if main else OUTSIDE)]


def identity(page: tuple[int, int, bool, list[str]]) -> int:
    """The same number for pages of a host with equal streams."""
    return xxhash.xxh3_64_intdigest(repr(page[:3]).encode()) - (1 << 63)


def stream(blocks: list[str]) -> list[bytes]:
    """Of each block, a mark and its tokens, with spaces between."""
    return [f"\x1e {b}".encode("utf-8", "surrogatepass") for b in blocks]


def salted(tokens: np.ndarray, hosts: np.ndarray) -> np.ndarray:
    """Token codes that differ between hosts."""
    with np.errstate(over="ignore"):
        return tokens * np.uint64(0x9E3779B97F4A7C15) + hosts


def filters(pages: list[tuple[int, int, bool, list[str]]], depth: int = DEPTH) -> Iterator[dict]:
    """The words of 64 bits that runs of the pages set in their hosts' filters."""
    hashes = WordHashes()
    for host, found in groupby(sorted(pages, key=lambda p: p[0]), lambda p: p[0]):
        bits = np.zeros(FILTER, bool)
        for _, _, _, blocks in found:
            tokens = hashes.of([t for b in stream(blocks) for t in b.split(b" ")])
            bits[windows(salted(tokens, np.array([host]).view(np.uint64)), depth) % np.uint64(FILTER)] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        for slot in np.flatnonzero(words).tolist():
            yield {"host": host, "slot": slot, "bits": int(words[slot])}


def press_filter(slots: list[int], bits: list[int]) -> bytes:
    """A filter of such words; empty if it holds everything."""
    words = np.zeros(FILTER // 64, np.int64)
    words[slots] = bits
    return b"" if 2 * np.unpackbits(words.view(np.uint8)).sum() > FILTER else zstandard.compress(words.tobytes())


def may_hold(pressed: bytes, codes: np.ndarray) -> np.ndarray:
    """Which runs may be in a filter."""
    if not pressed:
        return np.ones(len(codes), bool)
    bits = np.unpackbits(np.frombuffer(zstandard.decompress(pressed), np.uint8), bitorder="little")
    return bits[codes.view(np.uint64) % np.uint64(FILTER)] > 0


class Unit:
    """The suffix array over the streams of a unit's pages, (host code, page code, main, blocks) each.

    ``starts`` are the places of the runs of ``depth`` tokens in the order of the array, ``group`` numbers equal ones;
    ``on`` has the distinct pages of each group, ``code`` its hash, ``host`` the number of its host, and ``open`` whether a
    page without a main part has it. Pages that ``again`` has the identity of are left out of ``on`` and ``totals``.
    """

    def __init__(self, pages: list[tuple[int, int, bool, list[str]]], depth: int = DEPTH, again: frozenset[int] = frozenset()) -> None:
        self.depth, self.number = depth, {}
        kept = []
        for page in pages:
            if page[:3] not in self.number:
                self.number[page[:3]] = len(kept)
                kept.append(page)
        self.hosts, host = np.unique(np.array([p[0] for p in kept], np.int64), return_inverse=True)
        counts_here = np.array([not again or identity(p) not in again for p in kept], bool)
        self.totals = np.bincount(host[counts_here], minlength=len(self.hosts))  # distinct pages of each host
        self.main = np.array([p[2] for p in kept], bool)
        # A block is a mark and its tokens. A token's number is its place among the distinct ones, its code a hash of it.
        texts = pa.array([b for p in kept for b in stream(p[3])], pa.binary()).cast(pa.large_binary())
        found = pc.split_pattern(texts, pattern=b" ")
        self.sizes = np.diff(found.offsets.to_numpy())
        of_page = np.repeat(np.arange(len(kept)), [len(p[3]) for p in kept])
        counts = np.bincount(of_page, self.sizes, len(kept)).astype(np.int64)
        coded = found.values.dictionary_encode()
        numbers = coded.indices.to_numpy().astype(np.int64)
        codes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        tokens = codes[numbers] if len(numbers) else np.empty(0, np.uint64)
        self.page = np.repeat(np.arange(len(kept)), counts)  # of each token
        self.blocks = np.concatenate(([0], np.cumsum(np.bincount(of_page, minlength=len(kept)))))  # of each page
        own = salted(tokens, self.hosts.view(np.uint64)[host[self.page]])
        ends = np.cumsum(counts)
        whole = np.arange(len(tokens)) + depth <= ends[self.page]
        rank = pd.factorize(numbers * np.int64(max(len(self.hosts), 1)) + host[self.page])[0]
        span = 1
        while span < depth and len(rank):  # prefix doubling; runs that leave their page are left out at the end
            step = min(span, depth - span)
            following = np.zeros(len(rank), np.int64)
            following[:-step] = rank[step:]
            rank = pd.factorize(rank * np.int64(len(rank) + 1) + following)[0]
            span += step
        order = np.argsort(rank, kind="stable")
        self.starts = order[whole[order]]
        first = np.diff(rank[self.starts], prepend=-1) > 0
        self.group = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        owner = self.page[self.starts]
        # Places of a group are in page order, as the sort is stable.
        fresh = (first | (np.diff(owner, prepend=-1) != 0)) & counts_here[owner]
        self.on = np.add.reduceat(fresh.astype(np.int64), heads) if len(heads) else np.empty(0, np.int64)
        self.open = np.logical_or.reduceat(~self.main[owner], heads) if len(heads) else np.empty(0, bool)
        self.host = host[owner[heads]]
        self.code = windows(own, depth).view(np.int64)[self.starts[heads]] if len(heads) else np.empty(0, np.int64)

    def levels(self) -> np.ndarray:
        """Of each group, by this unit's pages alone: 0, 1 for repeated or 2 for site-wide."""
        return level(self.on, self.totals[self.host])

    def texts(self, levels: np.ndarray, pages: list[tuple[int, int, bool, list[str]]]) -> Iterator[str]:
        """The text of each page: its blocks but for those of whose tokens more than half are covered."""
        need = np.where(self.main, 2, 1)[self.page[self.starts]]
        hit = self.starts[levels[self.group] >= need]
        change = np.zeros(len(self.page) + self.depth + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + self.depth, -1)
        covered = np.cumsum(change)[: len(self.page)] > 0
        at = np.concatenate(([0], np.cumsum(self.sizes)))
        covered[at[:-1]] = False  # the marks don't count
        sums = np.concatenate(([0], np.cumsum(covered)))
        goes = 2 * (sums[at[1:]] - sums[at[:-1]]) > self.sizes - 1
        for page in pages:
            first = self.blocks[self.number[page[:3]]]
            yield "\n".join(b for i, b in enumerate(page[3]) if not goes[first + i])


def level(on, total):
    """0, 1 for repeated or 2 for site-wide, of substrings on so many of a host's distinct pages."""
    return np.where((on >= SITE_PAGES) & (on >= SITE_SHARE * total), 2, np.where(on >= 2, 1, 0))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", depth: int = DEPTH) -> DataFrame:
    """key, url, text, n_chars of each row of pages.

    Text is the candidates that stay, joined by line feeds, as the module says; empty if there is none. Null or empty html
    gives an empty text; a null URL belongs to the host "". Pages of any length are taken whole. Repeated rows are extracted
    each, and an empty table gives an empty one; other columns are not read. ``pages`` is read twice, for the number of
    pages of each host and for the pages; the two need not agree row by row.
    """
    kind = pages.schema[key].dataType.simpleString()
    host = F.xxhash64(F.coalesce(raw_host(F.col(url)), F.lit("")))
    hosts = staged(pages.select(host.alias("host")).groupBy("host").count(), "hosts")
    parts = max(1, -(-(hosts.agg(F.sum("count")).first()[0] or 0) // SHARD_PAGES))
    many = hosts.where(F.col("count") > SHARD_PAGES).select("host", F.ceil(F.col("count") / SHARD_PAGES).alias("units"))

    def parse(rows: Iterator[dict]) -> Iterator[dict]:
        """Parts of units, pressed: texts cross the network in that form."""
        press, held, size = zstandard.ZstdCompressor(level=6), {}, 0

        def flush() -> Iterator[dict]:
            for shard, part in held.items():
                yield {"shard": shard, "body": press.compress(pickle.dumps(part, 5))}

        for row in rows:
            main, found = candidates(row["h"])
            page = xxhash.xxh3_64_intdigest("\x1f".join(found).encode("utf-8", "surrogatepass")) - (1 << 63)
            part = (row["host"], page % (row["units"] or 1))
            shard = xxhash.xxh3_64_intdigest(repr(part).encode()) % parts
            held.setdefault(shard, []).append(((row["host"], page, main, found), row["k"], row["u"], row["units"] is not None))
            size += sum(map(len, found)) + 500
            if size > UNIT_CHARS:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    source = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), host.alias("host"), F.col(html).alias("h"))
    parsed = map_rows(source.join(small(many), "host", "left"), "shard long, body binary", parse, 500)
    dealt = parsed.repartition(parts, "shard").sortWithinPartitions("shard", F.xxhash64("body"))

    def pack(rows: Iterator[dict]) -> Iterator[dict]:
        """Units of a shard's parts: number, hosts that are in other units, too, whether a page of them has no main part, pages, body."""
        press, now, held, size, cut = zstandard.ZstdCompressor(level=9), None, [], 0, 0

        def unit(split: bool) -> dict:
            wide = [r[0] for r in held if r[3] or split]
            return {
                "unit": (now << 16) + cut,
                "hosts": list({p[0] for p in wide}),
                "open": not all(p[2] for p in wide),
                "pages": list({identity(p) for p in wide}) if split else [],
                "body": press.compress(pickle.dumps(held, 5)),
            }

        for row in rows:
            same = row["shard"] == now
            if held and (not same or size > UNIT_CHARS):
                yield unit(same or cut > 0)
                held, size, cut = [], 0, cut + 1 if same else 0
            now = row["shard"]
            part = pickle.loads(zstandard.decompress(row["body"]))
            held += part
            size += sum(len(b) for r in part for b in r[0][3])
        if held:
            yield unit(cut > 0)

    units = staged(map_rows(dealt, "unit long, hosts array<long>, open boolean, pages array<long>, body binary", pack, 1), "units")
    wide = units.select("unit", F.explode("hosts").alias("host"))

    def tell(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            wide = set(row["hosts"])
            yield from filters([r[0] for r in pickle.loads(zstandard.decompress(row["body"])) if r[0][0] in wide and not r[0][2]], depth)

    words = map_rows(units.where("open").select("hosts", "body"), "host long, slot int, bits long", tell, 50_000)
    words = words.groupBy("host", "slot").agg(F.bit_or("bits").alias("bits")).groupBy("host").agg(F.collect_list(F.struct("slot", "bits")).alias("words"))
    words = words.select("host", F.col("words.slot").alias("slots"), F.col("words.bits").alias("bits"))
    mixed = map_rows(words, "host long, filter binary", lambda rows: ({"host": r["host"], "filter": press_filter(r["slots"], r["bits"])} for r in rows), 500)
    copies = units.select("unit", F.explode("pages").alias("page"))
    first = copies.groupBy("page").agg(F.min("unit").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = copies.join(first, "page").where("unit <> first").groupBy("unit").agg(F.collect_list("page").alias("again"))
    told = staged(wide.join(mixed, "host").groupBy("unit").agg(F.collect_list(F.struct("host", "filter")).alias("filters")).join(again, "unit", "full"), "told")
    units = units.select("unit", "hosts", "body")
    shared = units.where(F.size("hosts") > 0).join(told, "unit", "left")

    def opened(row: dict, only: bool = False) -> tuple[list, Unit, np.ndarray]:
        """The unit's rows, its array, and which of its hosts are in other units, too; ``only`` leaves out the others."""
        rows, wide = pickle.loads(zstandard.decompress(row["body"])), set(row["hosts"])
        made = Unit([r[0] for r in rows if not only or r[0][0] in wide], depth, frozenset(row.get("again") or ()))
        return rows, made, np.array([h in wide for h in made.hosts.tolist()], bool)

    def ask(rows: Iterator[dict]) -> Iterator[dict]:
        """Counts of hosts (run is null) and runs; ``rest`` is the most that this unit can have of a run that it doesn't tell.

        A run that may be in its host's filter is ``exact``: every unit that has it tells it.
        """
        for row in rows:
            _, made, _ = opened(row, True)
            least = np.maximum(np.ceil(SITE_SHARE / 2 * made.totals), 1).astype(np.int64)
            exact = np.zeros(len(made.code), bool)
            filter_of = {f["host"]: f["filter"] for f in row["filters"] or ()}
            by_host = np.argsort(made.host, kind="stable")
            for own in np.split(by_host, np.flatnonzero(np.diff(made.host[by_host])) + 1):
                if len(own) and (pressed := filter_of.get(int(made.hosts[made.host[own[0]]]))) is not None:
                    exact[own] = may_hold(pressed, made.code[own])
            for h, host in enumerate(made.hosts.tolist()):
                yield {"unit": row["unit"], "host": host, "run": None, "n": int(made.totals[h]), "rest": int(least[h]) - 1, "open": False, "exact": False}
            for g in np.flatnonzero(np.where(exact, made.open | (made.on > 0), made.on >= least[made.host])).tolist():
                h = made.host[g]
                yield {"unit": row["unit"], "host": int(made.hosts[h]), "run": int(made.code[g]), "n": int(made.on[g]), "rest": int(least[h]) - 1, "open": bool(made.open[g]), "exact": bool(exact[g])}

    def site(n: Column) -> Column:
        return (n >= SITE_PAGES) & (n >= SITE_SHARE * F.col("total"))

    asked = staged(map_rows(shared, "unit long, host long, run long, n long, rest long, open boolean, exact boolean", ask, 50_000), "asked")
    totals = asked.where("run IS NULL").groupBy("host").agg(F.sum("n").alias("total"), F.sum("rest").alias("rests"))
    runs = asked.where("run IS NOT NULL").groupBy("host", "run").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"), F.max("open").alias("open"), F.max("exact").alias("exact"))
    most = F.col("n") + F.col("rests") - F.col("rest")
    sure = F.when(site(F.col("n")), True).when(~F.col("exact") & site(most), False)  # null: it isn't site-wide
    counted = runs.where("n > 1").join(totals, "host").select("host", "run", "n", "total", sure.alias("sure"), "open")
    counted = staged(counted.where("open OR sure IS NOT NULL"), "counted")
    sought = wide.join(counted.where("NOT sure").select("host", "run"), "host").join(asked.select("unit", "host", "run"), ["unit", "host", "run"], "left_anti")
    sought = staged(sought.groupBy("unit").agg(F.collect_list("run").alias("runs")), "sought")

    def look(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            _, made, _ = opened(row, True)
            for g in np.flatnonzero(np.isin(made.code, np.array(row["runs"], np.int64))).tolist():
                yield {"host": int(made.hosts[made.host[g]]), "run": int(made.code[g]), "more": int(made.on[g])}

    more = map_rows(shared.join(sought, "unit"), "host long, run long, more long", look, 50_000).groupBy("host", "run").agg(F.sum("more").alias("more"))
    summed = counted.join(more, ["host", "run"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))
    levels = staged(summed.select("host", "run", F.when(site(F.col("n")), 2).otherwise(1).alias("level")), "levels")
    open_runs = asked.where("open").select("unit", "host", "run").join(levels, ["host", "run"]).select("unit", "run", "level")
    site_runs = wide.join(levels.where("level = 2"), "host").select("unit", "run", "level")
    answers = open_runs.union(site_runs).groupBy("unit").agg(*[F.collect_set(F.when(F.col("level") == n, F.col("run"))).alias(f"level{n}") for n in (1, 2)])
    answers = staged(answers, "answers")

    def finish(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            held, made, wide = opened(row)
            levels = np.where(wide[made.host], 0, made.levels())
            for n in (1, 2):
                levels[wide[made.host] & np.isin(made.code, np.array(row[f"level{n}"] or [], np.int64))] = n
            for (_, k, u, _), text in zip(held, made.texts(levels, [r[0] for r in held])):
                yield {"k": k, "u": u, "text": text}

    done = map_rows(units.join(answers, "unit", "left"), f"k {kind}, u string, text string", finish, 500)
    return done.select(F.col("k").alias(key), F.col("u").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
