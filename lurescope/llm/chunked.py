"""Token ids of whole texts from the ids of their chunks, which are kept.

A text is cut before each space that has no white space beside it. The pre-tokenizers used here cut there whatever
stands around, so that a chunk's ids don't depend on its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

#: Entries of a generation; a cache holds two, and what wasn't used for a generation goes. This bounds memory, not results.
GENERATION = 250_000
#: Characters of texts that are cut into chunks at once.
SEGMENT = 2 << 20

_CUT = re.compile(r"(?<!\s) (?!\s|\Z)")


class Cache(dict):
    """A dict whose entries go when they weren't used while it was filled again."""

    def __init__(self, generation: int = GENERATION) -> None:
        super().__init__()
        self.generation, self.old = generation, {}

    def turn(self) -> None:
        if len(self) > self.generation:
            self.old = dict(self)
            self.clear()

    def missing(self, keys: set) -> list:
        """The keys that aren't kept; those of the older generation move to the younger."""
        new = keys - self.keys()
        kept = new & self.old.keys()
        self.update((k, self.old[k]) for k in kept)
        return list(new - kept)


class ChunkedEncoder:
    """learn(chunks) gives the ids of each chunk as little-endian unsigned 32-bit integers."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]]) -> None:
        self.learn = learn
        self.inner = Cache()  # a chunk without the space before it; None where white space stands at its ends
        self.known = Cache()  # other chunks

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Long texts are cut into parts between chunks, so that memory doesn't grow with their chunks."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for number, text in enumerate(texts):
            for part, inside in segments(text):
                held.append((number, part, inside))
                size += len(part)
                if size >= SEGMENT:
                    self._encode(held, out)
                    held, size = [], 0
        self._encode(held, out)
        return [o[0] if len(o) == 1 else b"".join(o) for o in out]

    def _encode(self, held: list[tuple[int, str, bool]], out: list[list[bytes]]) -> None:
        """Adds the ids of each (number, part, whether a chunk with a space before it begins there) to those of its text."""
        self.inner.turn()
        self.known.turn()
        split = [(["", *t[1:].split(" ")] if inside else t.split(" ")) for _, t, inside in held]
        rest = self.inner.missing(set(chain.from_iterable(s[1:] for s in split)))
        good = [p for p in rest if p and p.strip() == p]
        if len(good) < len(rest):
            self.inner.update(dict.fromkeys(p for p in rest if not p or p.strip() != p))
        self.inner.update(zip(good, self.learn([" " + p for p in good])))
        self._learn({s[0] for s in split})
        ids: list[bytes | None] = []
        for (_, _, inside), (head, *parts) in zip(held, split):
            try:
                found = b"".join(map(self.inner.__getitem__, parts))
            except TypeError:  # None stands for a part that white space is beside
                found = None
            if found is None or not inside and parts and (not head or head[-1].isspace()):
                ids.append(None)
            else:
                ids.append(self.known[head] + found)
        odd = [i for i, found in enumerate(ids) if found is None]
        cut = [chunks(held[i][1]) for i in odd]
        self._learn(set(chain.from_iterable(cut)))
        for i, found in zip(odd, cut):
            ids[i] = b"".join([self.known[c] for c in found])
        for (number, _, _), found in zip(held, ids):
            out[number].append(found)

    def forget(self) -> None:
        """Gives the memory back; a worker may serve quite other tasks next."""
        for cache in (self.inner, self.known):
            cache.clear()
            cache.old = {}

    def _learn(self, wanted: set[str]) -> None:
        new = self.known.missing(wanted)
        self.known.update(zip(new, self.learn(new)))


def segments(text: str, most: int | None = None) -> Iterator[tuple[str, bool]]:
    """(part, whether it begins inside the text): parts of about ``most`` characters, cut where chunks are."""
    most, at = most or SEGMENT, 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()], at > 0
        at = cut.start()
    yield text[at:] if at else text, at > 0


def chunks(text: str) -> list[str]:
    """The text cut before each space that has no white space beside it."""
    first, *rest = text.split(" ")
    out = [[first]]
    for part in rest:
        last = out[-1][-1]
        if not part or part[0].isspace() or not last or last[-1].isspace():
            out[-1].append(part)
        else:
            out.append(["", part])
    return [c for c in (" ".join(parts) for parts in out) if c]
