"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its own text is trainable.
The turns of a conversation are dealt together, in order, and folded into a stream; at each assistant turn the stream so
far is written out as an example with the span of its target. What stands behind the last assistant turn is in no
example, so that it follows in a last row without a target: no turn is lost.

A conversation of n turns makes up to n examples of up to n turns, which is what the expansion is. A worker has one
example in memory at a time, and the stream that it is a prefix of.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Within roles and texts the first character of every control string is
replaced by an escape, and so are the escape character itself and, in roles, line feeds. Reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.textops import map_rows

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this and of other templates; none is left in an escaped text.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\\n"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_FIND = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _FIND.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: _PLAIN[m[1]], text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the span of its text in it."""
    head = f"{START}{escape(role).replace(chr(10), _ESCAPES[chr(10)])}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    at = 0
    while at < len(formatted):
        stop = formatted.find(f"{END}\n", at)
        if not formatted.startswith(START, at) or stop < 0:
            raise ValueError("not a formatted turn")
        role, _, body = formatted[at + len(START) : stop].partition("\n")
        yield unescape(role), unescape(body)
        at = stop + len(END) + 1


def expanded(rows: Iterator[dict]) -> Iterator[dict]:
    """The examples of rows (k, role, text) that have each conversation's turns together and in order."""
    now, parts, size, number, open_turns = object(), [], 0, 0, False

    def rest() -> Iterator[dict]:
        if open_turns:
            yield {"k": now, "target_turn": None, "text": "".join(parts), "loss_start": None, "loss_end": None}

    for row in rows:
        if row["k"] != now:
            yield from rest()
            now, parts, size, number, open_turns = row["k"], [], 0, 0, False
        made, start, end = segment(row["role"], row["text"])
        parts.append(made)
        open_turns = row["role"] != "assistant"
        if not open_turns:
            parts = ["".join(parts)]
            yield {"k": now, "target_turn": number, "text": parts[0], "loss_start": size + start, "loss_end": size + end}
        size += len(made)
        number += 1
    yield from rest()


def _dealt(turns: DataFrame, key: str, order: str) -> DataFrame:
    empty = F.lit("")
    source = turns.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return source.repartition("k").sortWithinPartitions("k", "o", "role", "text")


def examples(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The written-out examples: key, target_turn (from 0; null for what no example has), text, loss_start, loss_end (in code points).

    Null roles and texts count as empty; turns are ordered by ``order`` (null first), then role and text, so that ties and
    repeated rows have one order and each of them counts. Rows with a null key are a conversation of their own. An empty
    table has no examples; long texts are kept whole; other columns are not read.
    """
    kind = turns.schema[key].dataType.simpleString()
    schema = f"k {kind}, target_turn long, text string, loss_start long, loss_end long"
    return map_rows(_dealt(turns, key, order), schema, expanded, 200).withColumnRenamed("k", key)


def digests(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """What a reader of the written-out examples finds in each conversation; ``examples`` says what odd rows count as.

    key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of all examples), n_examples. Each example is
    written and read back before the next is, so that their sum is in no memory. Turns are parsed out of what an example
    has beyond the one before, and the text under each loss mask is cut out and unescaped.
    """
    kind = turns.schema[key].dataType.simpleString()

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        now, state = object(), None
        for example in expanded(rows):
            if example["k"] != now:
                if state:
                    yield result(now, state)
                now, state = example["k"], {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "chars": 0, "formatted": 0, "examples": 0, "read": 0}
            for role, text in parse(example["text"][state["read"] :]):
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["n"] += 1
            state["read"] = len(example["text"])
            if example["target_turn"] is not None:
                target = unescape(example["text"][example["loss_start"] : example["loss_end"]])
                state["loss"].update(target.encode("utf-8", "surrogatepass"))
                state["chars"] += len(target)
                state["formatted"] += len(example["text"])
                state["examples"] += 1
        if state:
            yield result(now, state)

    def result(k, state: dict) -> dict:
        return {"k": k, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["chars"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["formatted"], "n_examples": state["examples"]}

    schema = f"k {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
    return map_rows(_dealt(turns, key, order), schema, work).withColumnRenamed("k", key)
