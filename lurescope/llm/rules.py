"""Quality rules: a learned decision list.

``text_statistics`` counts each text; ``learn`` fits an ordered list of threshold conjunctions by sequential covering
(grow by information gain on one part of the labelled rows, prune on the other part); ``expression`` writes the list as
one conditional Spark expression, which is what decides over all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.llm.textops import WordHashes, map_rows, windows
from lurescope.runtime import fresh

#: Labelled rows that the list is learned from at most, taken in the order of a hash of their keys.
LABELLED_ROWS = 20_000
#: Words that a kept text has at least, and the percentage of repeated words that it has at most.
MIN_WORDS, MAX_REPEATED = 50, 50

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def count_text(text: str | None, hashes: WordHashes) -> dict:
    """The statistics of one text; null has none."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if _WORDS.search(line):
            again += line in seen
            seen.add(line)
    ids = hashes.of(found)
    runs = windows(ids, 3)
    repeated = 0
    if len(runs):
        _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        if twice.any():
            covered = np.zeros(len(ids), bool)
            for i in range(3):
                covered[i : i + len(runs)] |= twice
            repeated = int(covered.sum())
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    data = np.frombuffer(raw, np.uint8)
    return {
        "n_words": len(found),
        "word_chars": len(text) - spaces,
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": again,
        "n_repeat_words": repeated,
        "n_lines": len(lines),
        "n_upper": int(((data >= 65) & (data <= 90)).sum()),
        "n_punct": sum(text.count(c) for c in ".,;:!?"),
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct")


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and counts of each row's whole text. Words are runs of other characters than space and U+0009 to U+000D.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_dup_lines (lines with a word that equal an
    earlier one), n_repeat_words (words in runs of three words that occur twice or more), n_lines, n_upper (A-Z),
    n_punct. Null counts as empty: all are 0, but for one line. Repeated rows are counted each.
    """

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        hashes = WordHashes()
        for row in rows:
            yield {"k": row["k"]} | count_text(row["t"], hashes)

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_rows(source, f"k {kind}, " + ", ".join(f"{c} long" for c in _COUNTS), work, 20_000).withColumnRenamed("k", key)


def features() -> dict[str, Column]:
    """What the rules test, as expressions over the counts; each is defined for empty texts too."""
    each = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": each("word_chars", "n_words"),
        "symbols_per_word": each("n_symbols", "n_words"),
        "dup_line_share": each("n_dup_lines", "n_lines"),
        "repeat_share": each("n_repeat_words", "n_words"),
        "upper_share": each("n_upper", "word_chars"),
        "punct_per_word": each("n_punct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        values = table[self.feature].to_numpy()
        return values >= self.threshold if self.at_least else values < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass
class Rule:
    """A conjunction that says a text is bad."""

    conditions: list[Condition] = field(default_factory=list)

    def covers(self, table: pd.DataFrame) -> np.ndarray:
        covered = np.ones(len(table), bool)
        for condition in self.conditions:
            covered &= condition.holds(table)
        return covered

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _candidates(table: pd.DataFrame, names: list[str], steps: int = 64) -> list[Condition]:
    out = []
    for name in names:
        values = np.unique(table[name].to_numpy())
        if len(values) > steps:
            values = np.unique(np.quantile(table[name], np.linspace(0, 1, steps), method="nearest"))
        middles = (values[1:] + values[:-1]) / 2
        out += [Condition(name, side, float(v)) for v in middles for side in (True, False)]
    return out


def _grow(table: pd.DataFrame, bad: np.ndarray, candidates: list[Condition]) -> Rule:
    """Adds the condition of most information gain until the rule covers bad rows only, or no condition gains."""
    rule, inside = Rule(), np.ones(len(table), bool)
    held = [(c, c.holds(table)) for c in candidates]
    while (inside & ~bad).any() and len(rule.conditions) < 6:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        base, best = math.log2(p / (p + n)), (1e-9, None, None)
        for condition, mask in held:
            now = inside & mask
            p1, n1 = (now & bad).sum(), (now & ~bad).sum()
            if p1 and (gain := p1 * (math.log2(p1 / (p1 + n1)) - base)) > best[0]:
                best = (gain, condition, mask)
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        inside &= best[2]
    return rule


def _prune(rule: Rule, table: pd.DataFrame, bad: np.ndarray) -> Rule:
    """Drops final conditions while that doesn't lower (p - n) / (p + n) on the pruning rows."""

    def worth(r: Rule) -> float:
        covered = r.covers(table)
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for keep in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:keep])
        if worth(shorter) >= worth(best):
            best = shorter
    return best


def learn(table: pd.DataFrame, label: str = "bad", precision: float = 0.95, most: int = 24) -> list[Rule]:
    """An ordered list of rules for the rows whose label is true; empty if there are none.

    Two of three rows grow each rule and the third prunes it. A rule is taken if it covers at least three bad rows and
    nearly none but bad rows, in the growing and in the pruning part; the first that isn't ends the list.
    """
    names = [c for c in table.columns if c not in (label, "fold")]
    fold = table["fold"].to_numpy() if "fold" in table else np.arange(len(table))
    rules: list[Rule] = []
    left = table.reset_index(drop=True)
    fold = np.asarray(fold) % 3
    while len(rules) < most:
        grow, prune = left[fold != 0], left[fold == 0]
        bad = grow[label].to_numpy(bool)
        if bad.sum() < 3 or not len(prune):
            break
        rule = _prune(_grow(grow, bad, _candidates(grow, names)), prune, prune[label].to_numpy(bool))
        if not rule.conditions:
            break
        ok = True
        for part, least in ((grow, 3), (prune, 0)):
            covered = rule.covers(part)
            p = (covered & part[label].to_numpy(bool)).sum()
            ok &= p >= least and p >= precision * covered.sum()
        if not ok:
            break
        rules.append(rule)
        outside = ~rule.covers(left)
        left, fold = left[outside].reset_index(drop=True), fold[outside]
    return rules


def expression(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that holds, else 0, as one conditional expression over the counts."""
    columns = features()
    out = None
    for number, rule in enumerate(rules, 1):
        tests = [columns[c.feature] >= F.lit(c.threshold) if c.at_least else columns[c.feature] < F.lit(c.threshold) for c in rule.conditions]
        test = tests[0]
        for t in tests[1:]:
            test = test & t
        out = F.when(test, F.lit(number)) if out is None else out.when(test, F.lit(number))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_sample(counted: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = LABELLED_ROWS) -> pd.DataFrame:
    """Features of at most ``rows`` labelled rows; of repeated keys in labels the lower label counts, nulls don't.

    Labelled rows are counted first, and only those under the share of hashes that ``rows`` are of all, with a margin, are
    sorted. So the driver gets about ``rows`` rows whatever the number of partitions. ``counted`` is read twice and must be
    a table. Without labels the sample is empty.
    """
    mark = fresh("rules_label", *counted.columns)
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias(mark))
    joined = counted.join(marks, key)
    total = max(joined.count(), 1)
    order = F.xxhash64(key)
    least = -(1 << 63)
    share = min(1.0, (1.1 * rows + 500) / total)
    near = joined.where(order <= F.lit(min(least + int(share * (1 << 64)), (1 << 63) - 1)))
    chosen = near.orderBy(order, key).limit(rows)
    return chosen.select(*[c.alias(n) for n, c in features().items()], (F.col(mark) == 0).alias("bad"), F.pmod(F.xxhash64(order), F.lit(3)).alias("fold")).toPandas()


def judged(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """counted with base_failed, rule (0 if none holds) and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = counted.withColumn("base_failed", base).withColumn("rule", expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
