"""Best-fit packing of tokenised documents by exact-complement hashing.

A document becomes its token ids and an end id. A longer one than a sequence is cut, its first piece taking what is left
over, so that all its other pieces fill sequences alone. What remains is counted by length: at most ``size`` counts,
whatever the corpus. On those counts the plan is made: lengths that fill a sequence alone, then pairs and triples found
through a hash index of their sums, as many of each as the counts allow, then best-fit for the rest. The plan says how
many times each combination of lengths is used, and the pieces of each length take its places in order of their number
among their length, which comes from counts of (length, slice) and needs no sort of all pieces of a length in one place.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lurescope.llm.chunked import ChunkedEncoder
from lurescope.llm.textops import map_rows
from lurescope.runtime import fresh, ship, staged

SIZE, END_ID = 1024, 2
#: Slices whose counts are summed up together.
GROUP = 1000


_encoders: dict[str, ChunkedEncoder] = {}


def encoder(path: str) -> ChunkedEncoder:
    """The worker's encoder; a worker that serves several tasks keeps it.

    The file's vocabulary and merges are run by tiktoken's merge loop, which takes a few times less time for each new
    chunk than the tokenizers library. It gives the same ids where each merge makes the next id, as ``_ranks`` checks,
    and where each token by itself is encoded as itself; tests compare both libraries on all tokens and on texts.
    Added tokens are ordinary text here; ``encoded`` cuts them out before.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={}).encode_ordinary

        def learn(new: list[str]) -> list[bytes]:
            ids = [encode(c) for c in new]
            ends = list(accumulate(map(len, ids), initial=0))
            whole = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1]).tobytes()
            return [whole[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]

        _encoders[path] = ChunkedEncoder(learn)
    return _encoders[path]


def _ranks(path: str) -> dict[bytes, int]:
    """Bytes and id of each token of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    # The library writes a byte as a character: printable ones of Latin-1 as they are, the others from U+0100 on in order.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        raise ValueError(f"{path}: ids don't follow the order of merges")
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}


@cache
def _added(path: str) -> dict[str, bytes]:
    """Content and id, as 32 bits, of each added token of the file."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    if made.get("normalizer") or any(t[flag] for t in made["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: a normalizer, or added tokens that depend on what is beside them")
    return {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in made["added_tokens"]}


def encoded(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as the tokenizers library gives them with add_special_tokens=False.

    Added tokens get their ids, the longest first where several start at a place, and what is between is encoded alone.
    """
    added = _added(path)
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    split = [cut.split(t) if any(a in t for a in added) else [t] for t in texts]
    found = iter(encoder(path).encode([p for parts in split for p in parts[::2]]))
    return [b"".join([added[p] if i % 2 else next(found) for i, p in enumerate(parts)]) for parts in split]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every piece; null text counts as empty and gives the end id alone.

    A text's tokens are those of the whole text, whatever its length. Rows that repeat are separate documents.
    """
    end = np.array([end_id], "<u4").tobytes()

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        batch, held = [], 0
        for row in rows:
            batch.append(row)
            held += len(row["t"] or "")
            if held > 1 << 20 or len(batch) >= 1000:
                yield from done(batch)
                batch, held = [], 0
        yield from done(batch)
        encoder(tokenizer).forget()

    def done(batch: list[dict]) -> Iterator[dict]:
        for row, ids in zip(batch, encoded(tokenizer, [r["t"] or "" for r in batch])):
            ids += end
            n, at, number = len(ids) // 4, 0, 0
            while at < n:
                length = (n - at) % size or size
                yield {"k": row["k"], "piece": number, "start": at, "length": length, "ids_crc32": zlib.crc32(ids[4 * at : 4 * (at + length)])}
                at, number = at + length, number + 1

    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    found = map_rows(source, f"k {kind}, piece int, start long, length long, ids_crc32 long", work, 20_000)
    return found.withColumnRenamed("k", key)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of each combination of lengths, longest first in each; together they use all counts."""
    left = Counter({n: c for n, c in counts.items() if c > 0})
    if any(not 1 <= n <= size for n in left):
        raise ValueError(f"lengths must be from 1 to {size}")
    out: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> bool:
        need = Counter(lengths)
        times = min(left[n] // k for n, k in need.items())
        if times > 0:
            out.append((tuple(sorted(lengths, reverse=True)), times))
            for n, k in need.items():
                left[n] -= k * times
                if not left[n]:
                    del left[n]
        return times > 0

    if left[size]:
        use(size)
    for a in sorted(left, reverse=True):
        if 2 * a >= size and size - a in left and a in left:
            use(a, size - a)
    _triples(left, use, size)
    _best_fit(left, out, size)
    return out


def _triples(left: Counter, use, size: int) -> None:
    """Triples that fill a sequence: each largest length looks its complement up in an index of pair sums."""
    lengths = sorted(left, reverse=True)
    sums: dict[int, list[tuple[int, int]]] = {}
    for i, a in enumerate(lengths):
        for b in lengths[i:]:
            if a + b < size:
                sums.setdefault(a + b, []).append((a, b))
    for c in lengths:
        for a, b in sums.get(size - c, ()):
            if c not in left:
                break
            if a <= c and a in left and b in left:
                use(c, a, b)


def _best_fit(left: Counter, out: list[tuple[tuple[int, ...], int]], size: int) -> None:
    """Best-fit decreasing over what is left. Bins with the same content are one entry and are filled together."""
    open_bins: dict[int, list[list]] = {}  # gap: [lengths, times]
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = size - sum(lengths)
        if not gap:
            out.append((lengths, times))
            return
        if gap not in open_bins:
            bisect.insort(gaps, gap)
        open_bins.setdefault(gap, []).append([lengths, times])

    for n in sorted(left, reverse=True):
        count = left[n]
        while count and (at := bisect.bisect_left(gaps, n)) < len(gaps):
            gap = gaps[at]
            entry = open_bins[gap][-1]
            times = min(count, entry[1])
            entry[1] -= times
            if not entry[1]:
                open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap]
                    gaps.pop(at)
            put((*entry[0], n), times)
            count -= times
        fit = size // n
        if count >= fit:
            put((n,) * fit, count // fit)
        if count % fit:
            put((n,) * (count % fit), 1)
    left.clear()
    for entries in open_bins.values():
        out.extend((lengths, times) for lengths, times in entries)


def places(plan_rows: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """length, rank (of the first piece that takes it), sequence, offset: each place of each combination, by length and rank."""
    rows, taken, sequence = [], Counter(), 0
    for lengths, times in plan_rows:
        offset = 0
        for n in lengths:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def pack(found: DataFrame, key: str = "doc_id", size: int = SIZE, slices: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset; every piece is placed once and sequences have no gaps.

    ``found`` is read twice and must give the same rows again: a table, not a computation. The plan has a few places a
    length at most, so that its broadcast doesn't grow with the corpus. Repeated rows are separate pieces.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # one row a length, at most size rows
    table = places(plan(counts, size))
    # Within a length, pieces are numbered by slice and then within the slice; slices are small enough to sort. Counts of
    # slices are summed up within groups of GROUP slices, and those of groups, so that no task sums up all slices.
    slices = slices or max(1, -(-sum(counts.values()) // 5_000))
    at, group, before, within = (fresh(n, *found.columns) for n in ("pack_slice", "pack_group", "pack_before", "pack_within"))
    cut = found.withColumn(at, F.pmod(F.xxhash64(key, "piece", "start"), F.lit(slices)))
    sums = cut.groupBy("length", at).agg(F.count("*").alias("n")).withColumn(group, F.floor(F.col(at) / GROUP))
    earlier = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("length", group).agg(F.sum("n").alias("n")).select("length", group, earlier(["length"], group).alias(before))
    sums = sums.withColumn(within, earlier(["length", group], at)).join(groups, ["length", group]).select("length", at, (F.col(before) + F.col(within)).alias(before))
    number = F.row_number().over(Window.partitionBy("length", at).orderBy(key, "piece", "start", "ids_crc32")) - 1
    ranked = cut.withColumn(within, number).join(sums, ["length", at])
    starts = spark.sparkContext.broadcast({int(n): (g["rank"].to_numpy(), g["sequence"].to_numpy(), g["offset"].to_numpy()) for n, g in table.groupby("length")})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
            rank = (rows[before] + rows[within]).to_numpy(np.int64)
            lengths = rows["length"].to_numpy()
            for n in np.unique(lengths):
                mine = lengths == n
                first, base, at = starts.value[int(n)]
                entry = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = base[entry] + rank[mine] - first[entry]
                offset[mine] = at[entry]
            yield rows.assign(sequence_id=sequence, offset=offset)[names]

    names = [*found.columns, "sequence_id", "offset"]
    schema = StructType([*found.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    ship(spark)
    return ranked.mapInPandas(placed, schema)


def best_fit_pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """All pieces of all documents, packed; see ``pieces`` and ``pack``. An empty table gives an empty result."""
    return pack(staged(pieces(docs, tokenizer, key, text, size, end_id), "pieces"), key, size)
