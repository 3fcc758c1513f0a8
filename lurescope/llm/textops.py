"""Words, shingles and Arrow plumbing that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lurescope.runtime import ship

#: Entries after which a worker's cache of word hashes starts anew; this bounds memory, not results.
CACHE_ENTRIES = 300_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word (bytes), computed once while it stays in the cache."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D, as UTF-8, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, which is a bijection."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def windows(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes, in order; none if there are fewer words."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mixed(ids[:n] + _STEP * np.uint64(k))
        for i in range(1, k):
            out = mixed(out * np.uint64(3) + ids[i : n + i])
    return out


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of a text's shingles: runs of k words, or the whole text as one if it has fewer."""
    return np.unique(windows(ids, min(k, len(ids)))) if len(ids) else ids


def map_rows(df: DataFrame, schema: StructType | str, work: Callable[[Iterator[dict]], Iterator[dict]], batch: int = 2000) -> DataFrame:
    """mapInArrow with work over a partition's rows, one dict a row; output leaves in batches of ``batch`` rows or 8 MB."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in work(row for b in batches for row in rows_of(b)):
            out.append(row)
            size += sum(len(v) for v in row.values() if isinstance(v, (str, bytes, list, np.ndarray)))
            if len(out) >= batch or size >= 8 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[dict]:
    for at in range(0, batch.num_rows, step):
        yield from batch.slice(at, step).to_pylist()


def row_ids() -> Iterator[int]:
    """Numbers that no other partition of the same job gives out."""
    context = TaskContext.get()
    at = (context.partitionId() if context else 0) << 36
    while True:
        yield at
        at += 1
