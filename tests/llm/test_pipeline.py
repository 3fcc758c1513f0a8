"""The pipeline's stages on a small table, each against a plain version of what it should do with its own input."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lurescope.llm import classifier, packing, spans

ODD = [(None, None), (None, "No key stands here, but there is a text with some words."), (900_001, None), (900_002, ""), (900_003, " \n "), (900_004, "word " * 20_000), (900_005, "Same row twice."), (900_005, "Same row twice.")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(21)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    copies = [(800_000 + i, *r[1:]) for i, r in enumerate(rng.sample(rows, 15))]
    near = [(810_000 + i, f"{r[1]} One more word.", *r[2:]) for i, r in enumerate(rng.sample(rows, 15))]
    odd = [(k, t, "en" if i % 2 else None, None, None) for i, (k, t) in enumerate(ODD)]
    made = spark.createDataFrame(rows + copies + near + odd, docs.schema).withColumn("_key", F.lit("x")).withColumn("_code", F.lit(3))
    made.repartition(4).write.parquet(f"file://{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def _lower(text):
    return (text or "").encode().lower()


def _exact(rows):
    best, out = {}, []
    for r in rows:
        t = _lower(r["text"])
        if t not in best or (r["doc_id"] is not None and (best[t] is None or r["doc_id"] > best[t])):
            best[t] = r["doc_id"]
    for r in rows:
        t = _lower(r["text"])
        if t in best and best[t] == r["doc_id"]:
            del best[t]
            out.append(r)
    return out


def _near(rows):
    sets = []
    for r in rows:
        w = _lower(r["text"]).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if not sets[i] or least.get(find(i)) == r["doc_id"]]


def _spans(rows):
    """Texts without the sentences of runs that another text or place has before, from a plain dictionary of all runs."""
    first, covered = {}, {}
    split = [[tuple((r["text"] or "")[a:b].split()) for a, b in spans.sentences(r["text"] or "")] for r in rows]
    places = [(spans.places([len(s) for s in found]), found) for found in split]
    rank = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0))
    for i in rank:
        for a, b in places[i][0]:
            if first.setdefault(tuple(places[i][1][a:b]), (i, a)) != (i, a):
                covered.setdefault(i, set()).update(range(a, b))
    return [r | ({"text": spans.without(r["text"], covered[i])} if i in covered else {}) for i, r in enumerate(rows)]


def _bag(rows):
    return sorted(repr((r["doc_id"], r["text"], r["lang"], r["source"])) for r in rows)


def test_each_stage_on_what_the_one_before_kept(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, tables)
        if name == "packed":
            rows = out.toPandas().sort_values(["sequence_id", "offset"])
            ends = rows.groupby("sequence_id")["length"].cumsum()
            assert (rows["offset"] == ends - rows["length"]).all() and ends.max() <= packing.SIZE
            assert (rows["piece"] == 0).sum() == len(before)
            assert rows["sequence_id"].nunique() <= np.ceil(rows["length"].sum() / packing.SIZE) + 2
            continue
        assert out.columns == columns
        after = [r.asDict() for r in out.collect()]
        if name == "quality":
            judged = classifier.judged(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()
            kept = {(r.doc_id, r.code, r.lang) for r in judged if r.kept}
            coded = docs.withColumn("h", F.xxhash64("text")).collect()
            expected = [r.asDict() for r in coded if (r.doc_id, r.h, r.lang) in kept]
            assert all(r.kept == (r.log_ppl is not None and r.low <= r.log_ppl <= r.high) for r in judged)
        else:
            expected = {"exact_copies": _exact, "near_copies": _near, "repeated_spans": _spans}[name](before)
        assert _bag(after) == _bag(expected), name
        if name == "repeated_spans":
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
        docs = spark.createDataFrame([tuple(r[c] for c in columns) for r in after], out.schema)


def test_run_on_whole_and_on_empty_tables(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 100
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
