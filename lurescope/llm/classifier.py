"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on every trusted text of the training folds. Each partition counts its own n-grams and the counts
are summed by n-gram; lower orders count the distinct left neighbours of an n-gram, unless it stands at the start of a
text, where they keep plain counts. Discounts and backoff weights are aggregations over those counts.

For scoring, documents are put together into shards of bounded size. Each shard asks for the distinct n-grams of its own
texts, the requests join the model, and shard and answers meet again by the shard's number. A text's perplexity is that
of its characters; a language's threshold comes from quantiles over the trusted texts of the folds that weren't trained on.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.llm.textops import map_rows
from lurescope.runtime import ship, small, staged, without_rows

ORDER = 4
#: Characters of a shard; a longer text is a shard alone.
SHARD_CHARS = 4_000_000
#: One of FOLDS trusted texts calibrates the thresholds, the others train the model.
FOLDS = 5
#: Shares of trusted texts that the fences of a language give up: below, of all of them, and above, of those held out.
LOW, HIGH = 0.0025, 0.005
#: Held-out texts from which on those quantiles are used; with fewer, FENCE interquartile ranges beyond the quartiles.
CALIBRATION, FENCE = 50, 4.0

_PAD = "\x02"
_TABLE = str.maketrans({_PAD: " ", "\x00": " "})
_K = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, ORDER, np.int64).astype(np.uint64) | np.uint64(1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams that predict the characters of the texts (as strings), the number of each character's n-gram, and text ends."""
    padded = "".join(_PAD * (ORDER - 1) + (t.translate(_TABLE) if _PAD in t or "\x00" in t else t) for t in texts)
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) for t in texts])
    if not len(texts) or not ends[-1]:
        return np.empty(0, f"<U{ORDER}"), np.empty(0, np.int64), ends
    run = np.lib.stride_tricks.sliding_window_view(points, ORDER)
    with np.errstate(over="ignore"):
        code = np.zeros(len(run), np.uint64)
        for i in range(ORDER):
            code += points[i : len(run) + i].astype(np.uint64) * _K[i]
    where = np.flatnonzero(points[ORDER - 1 :] != ord(_PAD))
    number, _ = pd.factorize(code[where])
    first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1) > 0)
    made = np.ascontiguousarray(run[where[first]]).view(f"<U{ORDER}")[:, 0]
    return made, number, ends


def _batches(rows: Iterator[dict], most: int = SHARD_CHARS) -> Iterator[list[dict]]:
    batch, size = [], 0
    for row in rows:
        n = len(row["t"] or "")
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(row)
        size += n
    if batch:
        yield batch


def _number(batch: list[dict]) -> int:
    """A shard's number: 64 bits of a hash of its rows."""
    return xxhash.xxh3_64_intdigest(repr([(r["k"], r["code"]) for r in batch]).encode("utf-8", "surrogatepass")) - (1 << 63)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, c) of highest order over the column t, counted in each partition and then summed."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        for batch in _batches(rows):
            found, number, _ = grams([r["t"] or "" for r in batch])
            for gram, c in zip(found.tolist(), np.bincount(number, minlength=len(found)).tolist()):
                yield {"gram": gram, "c": c}

    return map_rows(texts.select("t"), "gram string, c long", work, 50_000).groupBy("gram").agg(F.sum("c").alias("c"))


def _discounts(row) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams that occur once to four times; fixed ones where those say nothing."""
    n = [row[f"n{i}"] or 0 for i in range(1, 5)]
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.0), i + 1.0) for i in range(3)]


def kneser_ney(texts: DataFrame) -> tuple[DataFrame, float]:
    """The model over the column t: (gram, alpha, gamma), and the probability of a character never seen.

    alpha is the discounted probability of the n-gram's last character after the others, gamma the weight of the next
    lower order after the n-gram as context. n-grams that aren't there have alpha 0 and gamma 1.
    """
    orders = {ORDER: staged(gram_counts(texts), "grams")}
    for k in range(ORDER - 1, 0, -1):
        lower = orders[k + 1].select(F.expr("substring(gram, 2)").alias("gram"), "c").groupBy("gram")
        made = lower.agg(F.count("*").alias("left"), F.sum("c").alias("plain"))
        orders[k] = staged(made.select("gram", F.when(F.col("gram").startswith(_PAD), F.col("plain")).otherwise(F.col("left")).alias("c")), "grams")
    counts = None
    for k, table in orders.items():
        row = table.agg(F.lit(k).alias("k"), F.count("*").alias("n"), *[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)])
        counts = row if counts is None else counts.unionByName(row)
    found = {r["k"]: r for r in counts.collect()}  # one row an order
    parts = None
    for k, table in orders.items():
        d = _discounts(found[k])
        discount = F.when(F.col("c") >= 3, F.lit(d[2])).when(F.col("c") == 2, F.lit(d[1])).otherwise(F.lit(d[0]))
        held = table.select("gram", "c", F.expr(f"substring(gram, 1, {k - 1})").alias("ctx"), discount.alias("d"))
        contexts = held.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
        alphas = held.join(contexts.select("ctx", "total"), "ctx").select("gram", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("alpha"), F.lit(None).cast("double").alias("gamma"))
        gammas = contexts.select(F.col("ctx").alias("gram"), F.lit(None).cast("double").alias("alpha"), F.least(F.col("mass") / F.col("total"), F.lit(1.0)).alias("gamma"))
        parts = alphas.unionByName(gammas) if parts is None else parts.unionByName(alphas).unionByName(gammas)
    model = parts.groupBy("gram").agg(F.max("alpha").cast("float").alias("alpha"), F.max("gamma").cast("float").alias("gamma"))
    return staged(model, "model"), 1.0 / ((found[1]["n"] or 0) + 1)


def log_probability(gram: str, model: dict[str, tuple[float, float]], unseen: float) -> float:
    """Natural logarithm of the probability of the last character after the others, lowest order first."""
    p = unseen
    for k in range(1, len(gram) + 1):
        part = gram[-k:]
        p = model.get(part, (0.0, 1.0))[0] + model.get(part[:-1], (0.0, 1.0))[1] * p
    return math.log(p)


def scores(docs: DataFrame, model: DataFrame, unseen: float, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, code (a hash of the text), lang, chars, log_ppl (nats a character; null without text) of each row.

    Documents are read twice, for the shards and for what they ask. A shard's number is a hash of its own rows, so that
    answers can only meet the texts that asked: if a task that is run again cuts its rows in another way, its shards have
    other numbers, and a shard with text that meets no answer raises an error instead of getting a score.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("code"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))

    trained = bool(model.limit(1).count())

    def shards(rows: Iterator[dict]) -> Iterator[dict]:
        pack = zstandard.ZstdCompressor(level=6)
        for batch in _batches(rows):
            yield {"shard": _number(batch), "body": pack.compress(pickle.dumps([(r["k"], r["code"], r["lang"], r["t"] or "") for r in batch], 5))}

    def requests(rows: Iterator[dict]) -> Iterator[dict]:
        for batch in _batches(rows):
            shard = _number(batch)
            found, _, _ = grams([r["t"] or "" for r in batch])
            wanted = set()
            for gram in found.tolist():
                for k in range(1, ORDER + 1):
                    wanted.add(gram[-k:])
                    wanted.add(gram[-k:-1])
            for gram in wanted:
                yield {"shard": shard, "gram": gram}

    def score(_, bodies: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(answers["gram"], zip(answers["alpha"].astype("float64").fillna(0.0), answers["gamma"].astype("float64").fillna(1.0))))
        out = []
        for body in bodies["body"]:
            rows = pickle.loads(zstandard.decompress(body))
            found, number, ends = grams([t for *_, t in rows])
            if trained and len(found) and not known:
                raise RuntimeError("a shard without answers: the documents gave other rows when they were read again")
            each = np.array([log_probability(g, known, unseen) for g in found.tolist()] or [0.0])
            total = np.concatenate(([0.0], np.cumsum(each[number]) if len(number) else [0.0]))
            at = 0
            for (k, code, name, t), end in zip(rows, ends):
                out.append((k, code, name, len(t), (total[at] - total[end]) / len(t) if t else None))
                at = end
        made = pd.DataFrame(out, columns=["k", "code", "lang", "chars", "log_ppl"])
        return made.astype({"log_ppl": "float64", "k": "Int64"} if kind in ("bigint", "int") else {"log_ppl": "float64"})

    made = map_rows(source, "shard long, body binary", shards, 1)
    asked = map_rows(source, "shard long, gram string", requests, 50_000)
    answers = asked.join(model, "gram").select("shard", "gram", "alpha", "gamma")
    return made.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(score, f"k {kind}, code long, lang string, chars long, log_ppl double").withColumnRenamed("k", key)


def trusted_keys(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that no label calls bad or toxic and at least one calls good; null labels say nothing."""
    marks = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return marks.where((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)).select(F.col(key).alias("trusted"))


def _fold(name: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), F.col(name)), F.lit(FOLDS))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, code, lang, chars, log_ppl, low, high, kept of each row of docs.

    A text is kept if its log-perplexity is within the fences of its language. Deviations from the median are divided by
    their usual spread at a text's length before quantiles are taken, as the means of short texts vary more. Held-out
    texts alone say what is too high; texts that were trained on score lower, so that all trusted texts say what is too
    low. A null language is one of its own; one without calibration texts takes the fences of all, and without any
    trusted text all rows with text are kept. Empty and null texts have no perplexity and are rejected.
    """
    trusted = trusted_keys(labels, key)
    side = small(trusted.where(_fold("trusted") != 0))
    texts = docs.join(side, docs[key] == side["trusted"], "left_semi").select(F.col(text).alias("t"))
    model, unseen = kneser_ney(texts)
    scored = staged(scores(docs, model, unseen, key, text, lang), "scores")
    named = F.coalesce("lang", F.lit(""))
    known = scored.where("log_ppl IS NOT NULL").join(trusted, F.col(key) == F.col("trusted")).withColumn("_lang", named).withColumn("held", F.when(_fold("trusted") == 0, F.col("log_ppl")))
    median = F.expr("percentile_approx(held, 0.5, 10000)").alias("median")
    wide = F.sqrt(1 + F.lit(2000) / F.greatest("chars", F.lit(1)))

    def fences(rows: DataFrame, by: list[str]) -> DataFrame:
        z = ((F.col("log_ppl") - F.col("median")) / wide).alias("z")
        rows = rows.select(*by, "median", z, F.col("held").isNotNull().alias("held"))
        q = f"percentile_approx(CASE WHEN held THEN z END, array(0.25, 0.75, {1 - HIGH}), 10000)"
        found = rows.groupBy(*by, "median").agg(F.count_if("held").alias("n"), F.expr(q).alias("q"), F.expr(f"percentile_approx(z, {LOW}, 10000)").alias("least"))
        few, q = F.col("n") < CALIBRATION, F.col("q")
        reach = FENCE * (q[1] - q[0] + 0.02)
        return found.where("n > 0").select(*by, F.struct("median", F.when(few, q[0] - reach).otherwise(F.col("least")).alias("low"), F.when(few, q[1] + reach).otherwise(q[2]).alias("high")).alias("f"))

    by_lang = staged(fences(known.join(small(known.groupBy("_lang").agg(median)), "_lang"), ["_lang"]), "fences")
    overall = fences(known.crossJoin(F.broadcast(known.agg(median))), []).agg(F.first("f").alias("all"))  # one row
    out = scored.join(small(by_lang), named == F.col("_lang"), "left").crossJoin(F.broadcast(overall))
    f = F.coalesce("f", "all")
    out = out.withColumn("low", f["median"] + f["low"] * wide).withColumn("high", f["median"] + f["high"] * wide)
    inside = F.coalesce((F.col("log_ppl") >= F.col("low")) & (F.col("log_ppl") <= F.col("high")), F.lit(True))
    return out.withColumn("kept", F.col("log_ppl").isNotNull() & inside).select(key, "code", "lang", "chars", "log_ppl", "low", "high", "kept")


def quality_filter(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names.

    Rows are told apart by key, text and language: of rows that repeat a key and a text, those in a language whose fences
    reject it go. Empty and null texts go; null keys are keys like others. An empty table gives an empty one.
    """
    place = lambda code: F.xxhash64(code, F.col(lang).cast("string"))
    gone = judged(docs, labels, key, text, lang).where("NOT kept").withColumnRenamed("lang", lang).select(key, place(F.col("code")).alias("code")).distinct()
    return without_rows(docs, gone, key, place(F.xxhash64(text)))
