"""Exact deduplication by Grace hashing.

Records are partitioned to spill files by bits of a hash, again and again, until the distinct contents of a file fit an
open-addressing table, which compares whole contents. It runs twice: first in each input partition, so that any content
crosses the network once for each partition that has it, however often it occurs there; then in each hash bucket of
what is left. A group of copies thus reaches one task as a row for each input partition, never as all its rows.

Spill files live in the task's own scratch folder while it runs and nothing else reads them; a task that is run again on
another executor writes its own.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lurescope.llm.textops import map_rows, row_ids
from lurescope.runtime import fresh, shards, staged, without_rows

#: Bytes of distinct contents that a table may hold before its file is partitioned again.
TABLE_BYTES = 96 << 20
#: Spill files that a level of partitioning has, as bits of the hash.
FAN_BITS = 4


class Table:
    """Open addressing with linear probing over complete contents; entries are numbered in order of arrival."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, content: bytes, code: int) -> int:
        """The number of the content, which is added if it is new."""
        mask = len(self.slots) - 1
        at = code & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.hashes[entry] == code and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        self.slots[at] = entry = len(self.contents)
        self.contents.append(content)
        self.hashes.append(code)
        self.bytes += len(content) + 100
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for entry, code in enumerate(self.hashes):
            at = code & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def grace(records: Iterator[tuple[bytes, object]], limit: int = TABLE_BYTES, level: int = 0, hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest, folder: str | None = None) -> Iterator[tuple[bytes, list]]:
    """(content, payloads) of each distinct content.

    Records go into a table. Once that is over the limit, the table and the rest of the records are partitioned to
    spill files by the next bits of the hash. Bits run out after 15 levels; contents that still share a file have one
    hash, and then the table takes them whatever its size, as another partitioning could not part them.
    """
    table, held, files = Table(), [], None
    scratch = None
    last = FAN_BITS * (level + 1) > 60
    try:
        for content, payload in records:
            code = hashed(content)
            if files is None:
                entry = table.find(content, code)
                if entry == len(held):
                    held.append([])
                held[entry].append(payload)
                if table.bytes <= limit or last or len(held) == 1:
                    continue
                scratch = tempfile.TemporaryDirectory(prefix="grace-", dir=folder)
                files = [open(os.path.join(scratch.name, str(i)), "wb") for i in range(1 << FAN_BITS)]
                for c, h, payloads in zip(table.contents, table.hashes, held):
                    file = files[_bucket(h, level)]
                    for p in payloads:
                        pickle.dump((c, p), file, 5)
                table, held = Table(), []
            else:
                pickle.dump((content, payload), files[_bucket(code, level)], 5)
        if files is None:
            yield from zip(table.contents, held)
            return
        for file in files:
            file.close()
            yield from grace(_read(file.name), limit, level + 1, hashed, scratch.name)
            os.unlink(file.name)
    finally:
        for file in files or ():
            file.close()
        if scratch:
            scratch.cleanup()


def _bucket(code: int, level: int) -> int:
    return code >> (64 - FAN_BITS * (level + 1)) & ((1 << FAN_BITS) - 1)


def _read(path: str) -> Iterator[tuple[bytes, object]]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TABLE_BYTES, rows_each: int = 3000) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 is identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest key stays. Rows with a null key are counted, and one of them stays only where all keys of its
    group are null; if a key and its text occur twice, one of those rows stays. Other columns are not read.
    """

    def local(rows: Iterator[dict]) -> Iterator[dict]:
        number = row_ids()
        for content, keys in grace(((ascii_lower(r["t"]), r["k"]) for r in rows), limit):
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                top = max((k for k in part if k is not None), default=None)
                yield {"part": next(number), "digest": hashlib.sha256(content).digest(), "content": content, "keys": part, "top": top, "n": len(part)}

    def whole(rows: Iterator[dict]) -> Iterator[dict]:
        for _, parts in grace(((r["content"], (r["part"], r["top"], r["n"])) for r in rows), limit):
            keep, first = max(((top, -part) for part, top, _ in parts if top is not None), default=(None, -min(p[0] for p in parts)))
            size = sum(n for _, _, n in parts)
            for part, _, _ in parts:
                yield {"part": part, "keep_id": keep, "group_size": size, "first": part == -first}

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    parts = staged(map_rows(source, f"part long, digest binary, content binary, keys array<{kind}>, top {kind}, n long", local), "exact")
    buckets = shards(parts, rows_each, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = parts.select("part", "content", "top", "n", F.xxhash64("digest").alias("bucket")).repartition(buckets, "bucket")
    groups = map_rows(dealt, f"part long, keep_id {kind}, group_size long, first boolean", whole)
    rows = parts.select("part", "digest", "keys").join(groups, "part")
    rows = rows.select("keep_id", "group_size", "first", F.lower(F.hex("digest")).alias("text_sha256"), F.posexplode("keys").alias("at", key), F.array_position("keys", F.col("keep_id")).alias("place"))
    stays = F.when(F.col("keep_id").isNull(), F.col("at") == 0).otherwise(F.col("at") + 1 == F.col("place"))
    return rows.select(key, "keep_id", "group_size", F.coalesce(F.col("first") & stays, F.lit(False)).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Where a key has several rows with the same text, one of them stays.
    """
    groups = staged(exact_groups(docs, key, text), "groups")
    digest = F.sha2(F.encode(_lowered(F.coalesce(F.col(text), F.lit(""))), "UTF-8"), 256)
    gone = groups.where("NOT kept").select(key, "text_sha256")
    if not groups.groupBy(key, "text_sha256").count().where("count > 1").limit(1).count():
        return without_rows(docs, gone, key, digest)  # keys tell the rows apart
    # A key and a text that occur twice: all rows that agree in both go or stay together, and then one of them stays.
    kept = groups.where("kept").select(key, "text_sha256")
    left = without_rows(docs, without_rows(gone, kept, key, F.col("text_sha256")).distinct(), key, digest)
    code, again = fresh("exact_code", *docs.columns), fresh("exact_again", *docs.columns)
    left = left.withColumn(code, digest)
    return left.withColumn(again, F.row_number().over(Window.partitionBy(key, code).orderBy(text))).where(F.col(again) == 1).drop(again, code)


def _lowered(column):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, letters, letters.lower())
