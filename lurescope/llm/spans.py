"""Substring deduplication by sliding sentence spans.

Every run of several consecutive sentences is hashed, equal hashes of all documents are brought together, and a sentence
that a run covers goes unless that run is the first of its kind, by key and then by place.

A run has at least 20 words, or at least three sentences and ten words. From each sentence the shortest run that starts
there and the shortest that ends there are taken, so that sentences of any length form runs, and that each sentence of a
passage is in a run of the passage if its whole sentences together have the words of a run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lurescope.llm.textops import map_rows
from lurescope.runtime import fresh, ship

#: A run has WORDS words at least, or FEW words and SENTENCES sentences.
WORDS, FEW, SENTENCES = 20, 10, 3
#: Runs that a worker keeps before it passes them on; this bounds memory, not results.
HELD = 200_000

_END = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences: they end after . ! or ? before white space, and at line breaks; no white space around."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def runs(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, 128-bit hash) of each run; words count and are compared as they stand."""
    split = [text[a:b].split() for a, b in sentences(text)]
    codes = [xxhash.xxh3_128_digest(" ".join(s).encode("utf-8", "surrogatepass")) for s in split]
    for at, end in places([len(s) for s in split]):
        yield at, end - at, xxhash.xxh3_128_digest(b"".join(codes[at:end]), seed=end - at)


def places(counts: list[int]) -> list[tuple[int, int]]:
    """(first sentence, sentence behind the last) of the shortest run from each sentence on and of the shortest up to each."""
    before = [0, *accumulate(counts)]

    def enough(at: int, end: int) -> bool:
        words = before[end] - before[at]
        return words >= WORDS or words >= FEW and end - at >= SENTENCES

    found, end = set(), 1
    for at in range(len(counts)):
        while end <= len(counts) and not enough(at, end):
            end += 1
        if end > len(counts):
            break
        found.add((at, end))
    at = 0
    for end in range(1, len(counts) + 1):
        while enough(at + 1, end):
            at += 1
        if enough(at, end):
            found.add((at, end))
    return sorted(found)


def without(text: str, drop: set[int]) -> str:
    """The text without these sentences and the white space behind each."""
    found = sentences(text)
    out, at = [], 0
    for i, (a, _) in enumerate(found):
        end = found[i + 1][0] if i + 1 < len(found) else len(text)
        if i in drop:
            out.append(text[at:a])
            at = end
    out.append(text[at:])
    return "".join(out).rstrip() if drop else text


def covered_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, code, sentences array<int>): for each row of docs that has any, the sentences to remove.

    ``code`` is a hash of the text, so that rows with a repeated key and different texts are told apart; rows that agree
    in both count as one. Null and empty texts have no sentences. Rows with a null key come last. Texts are gone through
    whole, one in memory at a time.

    The runs are made once and dealt once. Each worker keeps the first place that it has seen of up to HELD runs, so that
    a run which many texts have crosses the network once for each time that table fills, however often it occurs.
    """
    kind = docs.schema[key].dataType.simpleString()

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        firsts: dict[bytes, tuple] = {}
        for row in rows:
            here, again = {}, set()
            for at, n, digest in runs(row["t"] or ""):
                if digest in here:
                    again.update(range(at, at + n))
                else:
                    here[digest] = (row["k"] is None, row["k"], row["code"], at), n
            for at in sorted(again):  # what a text itself has before; sentences side by side go as one
                if at - 1 not in again:
                    yield made(b"", (None, row["k"], row["code"], at), next(i for i in range(1, len(again) + 1) if at + i not in again))
            for digest, (place, n) in here.items():
                held = firsts.setdefault(digest, (place, n))
                if held[0] < place:
                    yield made(b"", place, n)
                elif place < held[0]:
                    yield made(b"", *held)
                    firsts[digest] = place, n
            if len(firsts) > HELD:
                yield from (made(d, *first) for d, first in firsts.items())
                firsts = {}
        yield from (made(d, *first) for d, first in firsts.items())

    def made(digest: bytes, place: tuple, n: int) -> dict:
        """A run's first place so far or, without a digest, sentences that go for sure, dealt by a hash of their place."""
        _, k, code, at = place
        mixed = digest or xxhash.xxh3_128_digest(f"{code} {at}".encode())
        return {"h1": int.from_bytes(mixed[:8], "little", signed=True), "h2": int.from_bytes(mixed[8:], "little", signed=True), "sure": not digest, "k": k, "code": code, "at": at, "n": n}

    source = docs.select(F.col(key).alias("k"), _code(text).alias("code"), F.col(text).alias("t"))
    found = map_rows(source, f"h1 long, h2 long, sure boolean, k {kind}, code long, at int, n int", work, 50_000)
    order = Window.partitionBy("h1", "h2").orderBy("sure", F.col("k").isNull(), "k", "code", "at")
    later = found.withColumn("rank", F.rank().over(order)).where("sure OR rank > 1")
    spans = later.groupBy("k", "code").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    each = F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))
    return spans.select(F.col("k").alias(key), "code", F.array_sort(F.array_distinct(F.flatten(each))).alias("sentences"))


def span_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """docs with repeated sentences taken out of ``text``; with ``count``, that column gets the new length.

    All rows stay, also those whose text becomes empty; other columns are unchanged, whatever their names. Null texts stay
    null. Of texts that share a run, the one with the least key keeps it (a null key counts as the greatest); rows that
    repeat key and text keep the same sentences. An empty table gives an empty one.
    """
    dropped = covered_sentences(docs, key, text)
    names = docs.columns
    ship(docs.sparkSession)

    k, c, drop = (fresh(n, *names) for n in ("span_key", "span_code", "span_drop"))
    joined = docs.join(dropped.toDF(k, c, drop), F.col(key).eqNullSafe(F.col(k)) & (_code(text) == F.col(c)), "left")
    cut = F.pandas_udf(_without, StringType())(F.when(F.col(drop).isNotNull(), F.col(text)), F.col(drop))
    joined = joined.withColumn(text, F.when(F.col(drop).isNull(), F.col(text)).otherwise(cut))
    if count:
        joined = joined.withColumn(count, F.length(text).cast("long"))
    return joined.select(*names)


def _code(text: str) -> Column:
    """32 bits that tell rows with the same key apart."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def _without(texts, drops):
    return texts.combine(drops, lambda t, d: t if d is None or t is None else without(t, set(np.asarray(d).tolist())))
