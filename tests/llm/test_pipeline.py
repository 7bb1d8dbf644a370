"""The pipeline against a plain version of its stages."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from meshlark.llm import langid, mixing

from .test_operators import DOCS, ODD, check_shards, poisson
from .test_round_three import plain_classes, shingles


def plain_stages(spark, docs, bench):
    """Languages come from the model itself, whose scores have their own test; all else is done anew."""
    table = docs.select(*P.COLUMNS)
    model = langid.train(table.where(~langid.held_out(F.col("doc_id"))))
    accepted = {(r["doc_id"], r["text"]) for r in langid.predict(table, model, ["doc_id", "text"]).where(f"lang_pred <> 'und' and score >= {P.LEAST_SCORE}").collect()}
    rows = [r for r in table.collect() if (r["doc_id"], r["text"]) in accepted]
    yield rows
    classes = {d: c for d, _, c, _ in plain_classes([(r["doc_id"], r["text"]) for r in rows], 80, 5)}
    rows = [r for r in rows if r["doc_id"] == classes[r["doc_id"]]]
    yield rows
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [plain(b["text"]) for b in bench.collect()]
    rows = [r for r in rows if not any(i in plain(r["text"]) for i in items)]
    yield rows
    sizes = Counter(r["source"] for r in rows)
    whole, roots_sum = sum(sizes.values()), sum(math.sqrt(n) for n in sizes.values())
    out = []
    for r in rows:
        rate = math.sqrt(sizes[r["source"]]) / roots_sum * whole / sizes[r["source"]]
        u = (int(hashlib.md5(f"{mixing.SEED}:copies:{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        out += [r] * poisson(u, rate)
    yield out


def test_stages_against_plain_ones(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] and len(P.STAGES) == 5
    table = docs
    for (name, stage), want in zip(P.STAGES[:4], plain_stages(spark, docs, bench), strict=True):
        table = stage(spark, table, sf_dir).persist()
        assert table.columns == P.COLUMNS
        assert Counter(tuple(r) for r in table.collect()) == Counter(tuple(r) for r in want), name
    last = P.STAGES[4][1](spark, table, sf_dir).collect()
    check_shards(last, 24)
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in table.collect())
    run = P.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in run) == Counter((r["doc_id"], r["text_crc32"]) for r in last)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, sf_dir, empty):
    df = spark.createDataFrame([] if empty else ODD, DOCS).withColumn("fp", F.lit("clash")).withColumn("_gone", F.lit(1))
    for name, stage in P.STAGES:
        out = stage(spark, df, sf_dir)
        n = out.count()
        assert n == 0 if empty else n > 0, name
    if not empty:
        kept = P.near_duplicates(spark, df, sf_dir).select("doc_id").collect()
        ids = [r["doc_id"] for r in kept]
        # 1 and 2 are copies, but not the other text of 2; 3, 4 and 5 have no words
        assert sorted(i for i in ids if i is not None) == [1, 2, 3, 6, 7, 8] and ids.count(None) == 1


def test_rows_that_no_id_tells_apart_are_judged_one_by_one(spark, sf_dir):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma", "delta", "epsilon")]
    a, b, c, d, e = texts
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (5, d), (5, e), (5, e)]
    df = spark.createDataFrame([(i, t, "en", f"s{n % 2}", len(t)) for n, (i, t) in enumerate(rows)], DOCS).repartition(3)
    kept = P.near_duplicates(spark, df, sf_dir)
    assert kept.columns == P.COLUMNS
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter([(1, a), (None, b), (None, c), (5, d), (5, e)])


def test_decontamination_judges_rows_without_an_id(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = "nothing of the kind stands in this text, which is about the weather of the coast"
    rows = [(1, item), (2, clean), (None, f"Before it. {item} After it."), (None, clean), (None, clean), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = Counter((r["doc_id"], r["text"]) for r in P.decontaminate(spark, df, sf_dir).collect())
    assert got == Counter([(2, clean), (None, clean), (None, clean), (None, None)])


def test_near_duplicates_at_the_least_similarity(spark, sf_dir):
    """Recall over pairs at a five-word similarity of 0.8 to 0.9, and no pair below 0.8."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(20_000)}"
    rows, near = [], 0
    for i in range(400):
        words = [word() for _ in range(int(rng.integers(80, 200)))]
        other = list(words)
        share = 1.0
        aim = rng.uniform(0.72, 0.9)
        while share > aim:
            other[int(rng.integers(len(other)))] = word()
            a, b = shingles(" ".join(words), 5), shingles(" ".join(other), 5)
            share = len(a & b) / len(a | b)
        near += share >= 0.8
        rows += [(2 * i, " ".join(words), share), (2 * i + 1, " ".join(other), share)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows], DOCS)
    kept = {r["doc_id"] for r in P.near_duplicates(spark, df, sf_dir).select("doc_id").collect()}
    assert all(2 * i in kept for i in range(400))
    assert all(i in kept for i, _, share in rows if share < 0.8)
    caught = sum(i not in kept for i, _, share in rows if share >= 0.8)
    assert near > 150 and caught >= 0.9 * near
