"""Near-duplicates by b-bit MinHash.

Texts with the same set of shingles are one class. Each class has ``BANDS * ROWS`` minima: bands of whole minima give
candidates, and the lowest ``BITS`` bits of each minimum, packed into words, estimate the similarity of a candidate pair
from the number of equal fields, corrected for fields that agree by chance. Pairs whose estimate is well below the
threshold go; all others are confirmed on the full sets of shingles, as 64-bit hashes.

No bucket's pairs are emitted. First each member of a bucket is compared with one pivot of it, the member that shares
most with others, and classes linked so are tied together. What remains are buckets whose members are still in several
components; those are gone through in blocks of ``BLOCK`` members, where signatures and then full sets are compared in
place and only links come out. Each pair that shares a band is so either tied, or rejected, or confirmed: nothing is
capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.llm.textops import WordHashes, map_rows, mixed, row_ids, shingles, words
from lurescope.operators.components import connected_components
from lurescope.runtime import staged, without_rows

#: At a similarity of 0.8 a pair shares none of the bands with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, ROWS, BITS = 32, 5, 2
HASHES = BANDS * ROWS
WORDS = HASHES * BITS // 64
#: Standard deviations of the estimate that a pair may be below the threshold and still be confirmed on the sets.
SLACK = 5.0
#: Rounds with pivots; members of a block in the last pass.
ROUNDS, BLOCK = 1, 1000

_rng = np.random.Generator(np.random.PCG64(20))
_A = _rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint32)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set of shingles that isn't empty."""
    x = (mixed(found) >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 256):
            part = x[at : at + 256, None] * _A + _B
            part ^= part >> np.uint32(15)  # an odd multiple keeps low bits low; this is one-to-one, too
            np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's minima, different for each band."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for i in range(ROWS):
            key = mixed(key * np.uint64(3) + rows[:, i])
    return key.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of all minima: word j has the j-th bit plane's fields in order, so that fields never straddle words."""
    bits = (least[:, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").view("<i8")


def estimate(equal, hashes: int = HASHES, bits: int = BITS):
    """Similarity from the number of equal fields, corrected for those that agree by chance."""
    chance = 2.0**-bits
    return (equal / hashes - chance) / (1 - chance)


def least_equal(threshold: float) -> int:
    """Equal fields that a pair has at least, unless it is SLACK standard deviations below a pair at the threshold."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return int(HASHES * (p - SLACK * (p * (1 - p) / HASHES) ** 0.5))


_EVEN = 0x5555555555555555


def equal_fields(a: str, b: str) -> Column:
    """Equal two-bit fields of two packed signatures, by bit counts."""
    each = [f"bit_count((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & {_EVEN}L)" for i in range(WORDS)]
    return F.expr(f"{HASHES} - ({' + '.join(each)})")


def signatures(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """node (unique), key, code (a hash of the text), n_shingles, digest of the set, and bands and packed low bits unless the set is empty."""
    kind = docs.schema[key].dataType.simpleString()

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        hashes, number, known = WordHashes(), row_ids(), {}
        for row in rows:
            found = shingles(hashes.of(words(row["t"])), shingle)
            out = {"node": next(number), "k": row["k"], "code": row["code"], "n_shingles": len(found), "digest": None, "bands": None, "packed": None}
            if len(found):
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if digest not in known:
                    if len(known) > 2000:
                        known.clear()
                    least = minima(found)
                    known[digest] = (band_keys(least).tolist(), packed(least).tolist())
                out["digest"], (out["bands"], out["packed"]) = digest, known[digest]
            yield out

    source = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("code"), F.col(text).alias("t"))
    return map_rows(source, f"node long, k {kind}, code long, n_shingles long, digest binary, bands array<long>, packed array<long>", work, 5000)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, kept.

    Words are runs of other characters than space and U+0009 to U+000D, A-Z lower-cased. A set has the distinct runs of
    ``shingle`` words, or the whole text as one if it has fewer words. Rows are linked if 100 * intersection >= percent *
    union; component_id is the least key that links reach. Null texts and texts without words have an empty set and are
    linked with nothing: their component is their own key. Rows with the same key are one document for ``kept``, which
    is true where the key is its component's. Null keys come last: where a component has no other, component_id is null
    and its rows are kept. Other columns are not read.
    """
    return _judged(docs, key, text, shingle, percent).drop("code")


def _judged(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """near_groups with code, the hash of the text, which tells rows with a repeated key and different texts apart."""
    rows = staged(signatures(docs, key, text, shingle), "signatures")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("node").alias("node"), F.min("k").alias("top"))
    full = staged(classes.join(rows.select("node", "bands", "packed", "n_shingles"), "node"), "classes")
    linked = _components(docs, full, key, text, shingle, percent)
    labels = full.select("digest", "node", "top").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tops = labels.groupBy("component").agg(F.min("top").alias("component_id"))
    ids = labels.join(tops, "component").select("digest", "component_id")
    out = rows.select("k", "code", "n_shingles", "digest").join(ids, "digest", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("k")).otherwise(F.col("component_id"))
    return out.select(F.col("k").alias(key), "code", "n_shingles", own.alias("component_id"), F.coalesce(F.col("k") == own, F.col("k").isNull() & own.isNull()).alias("kept"))


def _components(docs: DataFrame, full: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    least = least_equal(percent / 100)
    entries = full.select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = entries.join(shared, "bucket")
    # A text at the centre of a group shares more buckets, and larger ones, with its members than they do among themselves.
    weight = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    buckets = staged(buckets.join(weight, "node"), "buckets")
    sets = _sets(docs, full, buckets.select("node").distinct(), key, text, shingle)
    packs = full.select("node", "packed")
    links = None
    labels = spark.createDataFrame([], "node long, component long")
    for step in range(ROUNDS):
        pairs = _estimated(_pivots(_open(buckets, labels) if step else buckets, step), packs, least)
        good = staged(_confirmed(pairs, sets, percent).where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
        links = good if links is None else links.unionByName(good)
        labels = staged(connected_components(links), "labels")
    rest = staged(_block_links(_open(buckets, labels), full.select("node", "bands", "packed", "n_shingles"), sets, least, percent), "links")
    if rest.limit(1).count():
        labels = connected_components(links.unionByName(rest))
    return labels


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets whose members are in more than one component: node, bucket, n, component."""
    marked = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = marked.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return marked.join(several, "bucket")


def _pivots(buckets: DataFrame, step: int) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's pivot, another one in each step. Members tied to it already are left out."""
    rank = _rank(step)
    pivot = buckets.groupBy("bucket").agg(F.min(rank).alias("least"))
    marked = buckets.withColumn("rank", rank).join(pivot, "bucket")
    tied = ["component"] if "component" in buckets.columns else []
    chosen = marked.where("rank = least").groupBy("bucket").agg(F.min("node").alias("pivot"), *[F.min_by(c, "node").alias("pivot_component") for c in tied])
    pairs = marked.join(chosen, "bucket").where("node <> pivot")
    if tied:
        pairs = pairs.where("component <> pivot_component")
    return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _rank(step: int) -> Column:
    """The order that pivots are chosen by: first those of the greatest weight, then by a hash that is another one in each step."""
    return -F.col("weight") if step == 0 else F.xxhash64(F.lit(step), F.col("node"))


def _estimated(pairs: DataFrame, packs: DataFrame, least: int) -> DataFrame:
    left = packs.select(F.col("node").alias("a"), F.col("packed").alias("x"))
    right = packs.select(F.col("node").alias("b"), F.col("packed").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(equal_fields("x", "y") >= least).select("a", "b")


def _sets(docs: DataFrame, full: DataFrame, nodes: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """node, shingles: the full sets of the classes that share a bucket with another, one row a class."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        hashes, last = WordHashes(), {}
        for row in rows:
            found = shingles(hashes.of(words(row["t"])), shingle)
            if len(found):
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if digest not in last:
                    if len(last) > 5000:
                        last.clear()
                    last[digest] = None
                    yield {"digest": digest, "shingles": found.view(np.int64)}

    wanted = full.join(nodes, "node").select("digest", "node", "top")
    keys = wanted.select(F.col("top").alias(key)).distinct()
    # Only texts under a key that leads such a class are read again. Where keys repeat or are null, texts of other classes
    # and copies under other keys are among them, so that the digest alone says whose set it is.
    source = docs.join(keys, docs[key].eqNullSafe(keys[key]), "left_semi").select(F.col(text).alias("t"))
    made = map_rows(source, "digest binary, shingles array<long>", work, 2000)
    chosen = made.join(wanted.select("digest", "node"), "digest")
    return staged(chosen.select("node", "shingles").dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked: the pairs, judged on their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    joined = pairs.join(right, "b").join(left, "a")
    both = F.size(F.array_intersect("s", "t"))
    union = F.size("s") + F.size("t") - both
    return joined.select("a", "b", (100 * both >= percent * union).alias("linked"))


def _block_links(buckets: DataFrame, marks: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """(src, dst): linked pairs of members of a bucket that are in different components.

    A bucket's members are dealt to blocks of about BLOCK, and each pair of blocks is a task's group. The first pass
    compares signatures and gives back the members that have a partner there; only for those the sets are fetched, and
    the second pass confirms. Neither emits pairs that aren't links.
    """
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    tasks = buckets.select("bucket", "node", "component", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    tasks = tasks.select("bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "component")
    marked = tasks.join(marks, "node")
    schema = "bucket long, lo int, hi int, mine int, node long, component long, bands array<long>, packed array<long>, n_shingles long"
    partnered = map_rows(_dealt(marked, 0), schema, _groups(lambda members: _partnered(members, least, percent)), 2000)
    linked = map_rows(_dealt(partnered.join(sets, "node"), 1), "src long, dst long", _groups(lambda members: _linked(members, least, percent)), 50_000)
    return linked.distinct()


def _dealt(rows: DataFrame, salt: int) -> DataFrame:
    group = F.xxhash64(F.lit(salt), "bucket", "lo", "hi")
    return rows.withColumn("_group", group).repartition("_group").sortWithinPartitions("bucket", "lo", "hi", "node").drop("_group")


def _groups(work):
    """work over the rows of each block pair, which a partition has in order."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        now, members = None, []
        for row in rows:
            group = (row["bucket"], row["lo"], row["hi"])
            if group != now:
                if len(members) > 1:
                    yield from work(members)
                now, members = group, []
            members.append(row)
        if len(members) > 1:
            yield from work(members)

    return run


def _plausible(members: list[dict], least: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): later members js that i may be linked with, in a block pair of one bucket.

    They are in different components, their sizes and signatures allow a link, and this bucket is the first that they
    share, so that each pair comes once.
    """
    sig = np.array([m["packed"] for m in members], np.int64).view(np.uint64)
    bands = np.array([m["bands"] for m in members], np.int64)
    part = np.array([m["component"] for m in members])
    mine = np.array([m["mine"] for m in members])
    size = np.array([m["n_shingles"] for m in members])
    here = int((bands[0] == members[0]["bucket"]).argmax())
    apart = members[0]["lo"] != members[0]["hi"]
    for i in range(len(members) - 1):
        later = slice(i + 1, len(members))
        good = (part[later] != part[i]) & (100 * np.minimum(size[later], size[i]) >= percent * np.maximum(size[later], size[i]))
        if apart:
            good &= mine[later] != mine[i]
        js = np.flatnonzero(good) + i + 1
        if len(js):
            x = sig[i] ^ sig[js]
            differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(_EVEN)).sum(axis=1)
            js = js[HASHES - differ >= least]
        if len(js):
            js = js[(bands[js] == bands[i]).argmax(axis=1) == here]
        if len(js):
            yield i, js


def _partnered(members: list[dict], least: int, percent: int) -> Iterator[dict]:
    found = np.zeros(len(members), bool)
    for i, js in _plausible(members, least, percent):
        found[i] = True
        found[js] = True
    for i in np.flatnonzero(found):
        yield members[i]


def _linked(members: list[dict], least: int, percent: int) -> Iterator[dict]:
    sets = [np.array(m["shingles"], np.int64) for m in members]
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    _, numbers = np.unique(flat, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(len(flat) + 1, bool)
    for i, js in _plausible(members, least, percent):
        own = numbers[starts[i] : starts[i + 1]]
        mark[own] = True
        for j in js:
            both = int(mark[numbers[starts[j] : starts[j + 1]]].sum())
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                yield {"src": members[i]["node"], "dst": members[j]["node"]}
        mark[own] = False


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document of each group, with all its columns. Rows go by key and text, not by key alone."""
    gone = _judged(docs, key, text, shingle, percent).where("NOT kept").select(key, "code").distinct()
    return without_rows(docs, gone, key, F.xxhash64(text))
