"""Byte-level BPE by recursive DuckDB queries.

Each worker has a DuckDB of its own with the merge table. A batch's new words become token-position rows; a recursive
query joins them to the merge table and contracts the leftmost pair of least rank of each word until no word has such a
pair. Words already known to the worker are not contracted again. Decoding joins ids to the vocabulary and aggregates
the pieces in the order of their positions, a slice of positions at a time, so that a text of any length passes.

The recursion keeps a row for each token and step of a word, which is the square of its length. A query therefore takes
words whose squared lengths have a bounded sum, and words over LONG_WORD bytes (no word of prose, but encoded data and
scripts without spaces) are contracted by a heap of pairs, which gives the same ids in n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.chunked import Cache, ChunkedEncoder
from lurescope.llm.textops import map_rows

#: Memory that a worker's DuckDB may use, and characters of texts that it is given together.
DUCKDB_MEMORY, BATCH_CHARS = "400MB", 3 << 20
#: Words over LONG_WORD bytes are contracted by a heap; a query's words have QUERY_ROWS as the sum of their squared lengths.
LONG_WORD, QUERY_ROWS = 128, 6 << 20
#: Tokens that one query decodes.
DECODE_TOKENS = 400_000

#: Places that a word's positions are numbered in: a token's place is word * PLACES + position, and positions stay dense.
PLACES = 1 << 24

CONTRACT = f"""
WITH RECURSIVE state(word, place, id, step) AS (
  SELECT word, place, id, 0 FROM tokens
  UNION ALL
  (WITH best AS (
     SELECT a.word, min(m.merged * {PLACES} + a.place % {PLACES}) AS found
     FROM state a JOIN state b ON b.place = a.place + 1 AND b.word = a.word
     JOIN merges m ON m.pair = a.id * {1 << 24} + b.id
     GROUP BY a.word),
   chosen AS (
     SELECT word, found // {PLACES} AS merged, word * {PLACES} + found % {PLACES} AS spot
     FROM best)
   SELECT s.word, CASE WHEN s.place > c.spot THEN s.place - 1 ELSE s.place END,
          CASE WHEN s.place = c.spot THEN c.merged ELSE s.id END, s.step + 1
   FROM state s JOIN chosen c ON s.word = c.word WHERE s.place <> c.spot + 1))
SELECT word, id
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
ORDER BY place
"""

DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS body
FROM ids JOIN vocabulary USING (id) GROUP BY doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def contract_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long word: a heap gives the leftmost pair of least rank, links skip what was merged away."""
    ends = list(range(1, len(raw) + 1))  # of the token that starts here; 0 where none does any more
    before = list(range(-1, len(raw) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and (mid := ends[at]) < len(raw) and (rank := ranks.get(raw[at : ends[mid]])) is not None:
            heapq.heappush(heap, (rank, at, ends[mid]))

    for at in range(len(raw) - 1):
        offer(at)
    while heap:
        rank, at, end = heapq.heappop(heap)
        mid = ends[at]
        if not mid or mid >= len(raw) or ends[mid] != end or ranks.get(raw[at:end]) != rank:
            continue
        ends[at], ends[mid] = end, 0
        if end < len(raw):
            before[end] = at
        offer(at)
        offer(before[at])
    out, at = [], 0
    while at < len(raw):
        out.append(ranks[raw[at : ends[at]]])
        at = ends[at]
    return out


def _letters(chunk: str) -> list[str] | None:
    """The matches of public_tokenizers.PATTERN in a chunk of letters, or of letters and one comma or full stop; else None."""
    body = chunk.removeprefix(" ")
    if body.isalpha():
        return [chunk]
    if body[:-1].isalpha() and body[-1] in ",.":
        return [chunk[:-1], chunk[-1]]
    return None


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import public_tokenizers

        self.ranks = ranks = load_ranks(path)
        self.pattern, self.by_letters = regex.compile(pattern), pattern == public_tokenizers.PATTERN
        self.words, self.chunked = Cache(400_000), ChunkedEncoder(self._learn)
        # What DuckDB can't hold goes to the task's scratch folder, which is removed when the worker ends.
        self.scratch = tempfile.TemporaryDirectory(prefix="bpe-")
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": self.scratch.name})
        merges = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._table("merges", pair=[(m[0] << 24) + m[1] for m in merges], merged=[m[2] for m in merges])
        # A byte string is held as text whose code points are its bytes, as DuckDB joins text but not bytes.
        self._table("vocabulary", strings=("piece",), id=list(ranks.values()), piece=[t.decode("latin-1") for t in ranks])
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def _table(self, name: str, strings: tuple[str, ...] = (), **columns) -> None:
        made = pa.table({k: pa.array(v, pa.string() if k in strings else pa.int64()) for k, v in columns.items()})
        self.db.register("incoming", made)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.chunked.encode(texts)

    def _learn(self, new: list[str]) -> list[bytes]:
        self.words.turn()
        found = [_letters(c) or self.pattern.findall(c) for c in new] if self.by_letters else list(map(self.pattern.findall, new))
        words = self.words.missing(set(chain.from_iterable(found)))
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        batch, size = [], 0
        for word, raw, rank in zip(words, raws, map(self.ranks.get, raws)):
            if rank is not None:
                self.words[word] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_WORD:
                self.words[word] = np.array(contract_long(raw, self.ranks), "<u4").tobytes()
            else:
                batch.append((word, raw))
                size += len(raw) * len(raw)
                if size > QUERY_ROWS:
                    self._contract(batch)
                    batch, size = [], 0
        self._contract(batch)
        one = self.words.__getitem__
        return [one(parts[0]) if len(parts) == 1 else b"".join(map(one, parts)) for parts in found]

    def _contract(self, batch: list[tuple[str, bytes]]) -> None:
        if not batch:
            return
        lengths = np.array([len(raw) for _, raw in batch])
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in batch), np.uint8)]
        word = np.repeat(np.arange(len(batch)), lengths)
        self._table("tokens", word=word, place=word * PLACES + np.arange(len(ids)) - starts, id=ids)
        found = self.db.execute(CONTRACT).fetchnumpy()
        whole = np.asarray(found["id"]).astype("<u4").tobytes()
        ends = np.searchsorted(np.asarray(found["word"]), np.arange(len(batch) + 1)).tolist()
        self.words.update((word, whole[4 * a : 4 * b]) for (word, _), a, b in zip(batch, ends, ends[1:]))

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for, from slices of at most DECODE_TOKENS ids over all lists."""
        ends = np.cumsum([len(ids) // 4 for ids in encoded])
        ids = np.frombuffer(b"".join(encoded), "<u4")
        parts: list[list[bytes]] = [[] for _ in encoded]
        for at in range(0, len(ids), DECODE_TOKENS):
            mine = ids[at : at + DECODE_TOKENS].astype(np.int64)
            pos = np.arange(len(mine))
            self._table("ids", doc=np.searchsorted(ends, at + pos, "right"), pos=pos, id=mine)
            for number, body in self.db.execute(DECODE).fetchall():
                parts[number].append(body.encode("latin-1"))
        return [b"".join(p) for p in parts]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; a worker that serves several tasks keeps it."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def bpe(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", arrays: bool = True) -> DataFrame:
    """Per row of docs: key, n_tokens, ids_sha256, decoded_sha256, and with ``arrays`` also ids and decoded.

    Matches of the pattern are encoded separately; strings of special tokens are ordinary text. Null counts as empty;
    an empty text has no tokens. A text of any length is encoded and decoded whole. Repeated rows are encoded each; other
    columns are not read. ``ranks_path`` is a file that every executor has.
    """

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        batch, held = [], 0
        for row in rows:
            batch.append(row)
            held += len(row["t"] or "")
            if held > BATCH_CHARS or len(batch) >= 4000:
                yield from done(batch)
                batch, held = [], 0
        if batch:
            yield from done(batch)

    def done(batch: list[dict]) -> Iterator[dict]:
        worker = codec(ranks_path, pattern)
        encoded = worker.encode([r["t"] or "" for r in batch])
        for row, ids, decoded in zip(batch, encoded, worker.decode(encoded)):
            out = {"k": row["k"], "n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(decoded).hexdigest()}
            if arrays:
                out |= {"ids": np.frombuffer(ids, "<u4").tolist(), "decoded": decoded}
            yield out

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * arrays
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_rows(source, schema, work).withColumnRenamed("k", key)
