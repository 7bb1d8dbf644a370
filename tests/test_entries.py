"""Retrieval by a document's own cards, overlaps, kernels against plain versions, raw documents, and the shared folder."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import entry, graph, kernels, plan, search, validation
from meshlark.plans import answers, lineage
from meshlark.sources import topology

from .test_documents import GOOD


@pytest.fixture(scope="module")
def minis(spark, sf_dir):
    devices, links = (x.where("arch_id <= 8").persist() for x in answers.minis(spark, sf_dir))
    return devices, links


def cards_of(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["arch_id"], r["place"])):
        out.setdefault(r["arch_id"], []).append(r["rule_id"])
    return out


def test_an_answer_depends_on_its_own_document(spark, minis):
    corpus = answers.corpus(spark)
    whole = cards_of(search.retrieve(corpus, *minis))
    assert len({tuple(v) for v in whole.values()}) > 3
    for arch in (1, 4, 8):
        alone = cards_of(search.retrieve(corpus, *(x.where(F.col("arch_id") == arch) for x in minis)))
        assert alone == {arch: whole[arch]}


def test_a_corpus_without_a_required_card_is_an_error(spark, minis):
    corpus = answers.corpus(spark)
    with pytest.raises(ValueError, match="CORE-002"):
        search.retrieve(corpus.where("rule_id <> 'CORE-002'"), *minis)
    with pytest.raises(ValueError, match="MAP-001"):
        search.retrieve(corpus.withColumn("phase", F.when(F.col("rule_id") == "MAP-001", "configuration").otherwise(F.col("phase"))), *minis)
    with pytest.raises(ValueError, match="k must"):
        search.retrieve(corpus, *minis, k=0)


def test_features_count_links_and_take_numbers_only(spark):
    net = {"ip_address": "10.0.0.1", "prefix_length": "31", "subnet_mask": None, "network_address": None}
    link = {"source": "a", "target": "s", "network": {}}
    docs = [("text", {"devices": [{"id": "s", "type": "switch"}, {"id": "a", "type": "pc", "network": net}], "links": [{"id": "x", **link}, {"id": "y", **link}]}), ("number", {"devices": [{"id": "a", "type": "pc", "network": {**net, "prefix_length": 31}}], "links": []})]
    parsed = topology.parse(spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "arch_id string, raw string"))
    facts = {r["arch_id"]: r for r in graph.facts(topology.devices(parsed), topology.links(parsed)).collect()}
    assert (facts["text"]["shared_switch"], facts["text"]["switch_links"], facts["text"]["small_prefix"]) == (False, True, False)
    assert facts["number"]["small_prefix"] and not facts["number"]["switch_links"]


def test_vectors_keep_the_best_over_many_batches(spark):
    rng = np.random.default_rng(2)
    table = rng.normal(size=(3000, 6)).round(1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(table)], "vec_id long, embedding array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = search.dense_top_k(df, df.where("vec_id % 500 = 0").withColumnRenamed("vec_id", "query_id"), 7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    for q in range(0, 3000, 500):
        scores = np.round(unit @ unit[q], 12)
        want = np.lexsort((np.arange(3000), -scores))[:7].tolist()
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_overlaps_by_leading_bits(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(200):
        p = int(rng.integers(0, 33))
        rows.append((int(rng.integers(0, 1 << 32)) >> (32 - p) << (32 - p), p))
    df = spark.createDataFrame([(f"{lo:032x}", p, q) for lo, p in rows for q in (0, 1, 7, 8, 30, 32)], "lo string, p int, q int")
    for r in df.withColumn("lead", validation._leading(F.col("lo"), F.col("q"), 4)).groupBy("q", "lead").agg(F.collect_set("lo").alias("los")).collect():
        assert len({int(lo, 16) >> (32 - r["q"]) for lo in r["los"]}) == 1


def test_close_pairs_are_all_close_pairs():
    rng = np.random.default_rng(1)
    points = rng.uniform(0, 200, (300, 2))
    i, j = kernels._close_pairs(points, 9.0)
    far = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1))
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(far <= 9.0, 1))), strict=True))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want) > 100


def test_cover_and_fit_against_plain_versions():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.uniform(0, 100, 4), rng.uniform(100, 200, 4)
        if rng.random() < 0.3:
            a[3] = b[1] = a[1]
        corner = rng.uniform(0, 200, (5, 2))
        boxes = np.concatenate([corner, corner + rng.uniform(5, 120, (5, 2))], axis=1)
        ends = [(p, q) for p in (a[:2], a[2:]) for q in (b[:2], b[2:])]
        p, q = min(ends, key=lambda e: math.dist(*e))
        n = max(2, int(math.dist(p, q) // 2))
        inside = 0
        for t in np.linspace(0, 1, n + 1):
            x, y = p + t * (q - p)
            inside += any(x1 - 1 <= x <= x2 + 1 and y1 - 1 <= y <= y2 + 1 for x1, y1, x2, y2 in boxes)
        share = inside / (n + 1)
        if abs(share - 0.5) > 1.5 / n:
            assert kernels._covered(a, b, boxes, 0.5) == (share >= 0.5)
        members = rng.uniform(0, 50, (4, 4)) * [4, 1, 4, 1]
        points, weight = members.reshape(-1, 2), np.repeat(np.hypot(members[:, 2] - members[:, 0], members[:, 3] - members[:, 1]), 2)
        middle = np.average(points, axis=0, weights=weight)
        axis = np.linalg.svd((points - middle) * np.sqrt(weight)[:, None])[2][0]
        along = (points - middle) @ axis
        got = kernels._fit(members)
        assert math.isclose(math.dist(got[:2], got[2:]), along.max() - along.min(), rel_tol=1e-6)


def test_raw_documents_are_checked_and_planned_behind_the_gate(spark):
    faulty = {"devices": GOOD["devices"][:1], "links": []}
    rows = [("good", json.dumps(GOOD)), ("faulty", json.dumps(faulty)), ("deep", '{"a":' + "[" * 70 + "]" * 70 + "}"), ("none", None), ("text", "{")]
    raw = spark.createDataFrame(rows, "arch_id string, raw string")
    found = {}
    for r in entry.check_raw(raw).collect():
        found.setdefault(r["arch_id"], set()).add(r["code"])
    assert "good" not in found and found["deep"] == {"json_nesting_limit"} and found["none"] == found["text"] == {"invalid_architecture"} and "missing_links" in found["faulty"]
    reviews = spark.createDataFrame([("good", json.dumps({"rule_ids": ["CORE-001"], "limitations": ["Linux runtimes do not establish exact vendor hardware or operating-system behavior."]}))], "arch_id string, content string")
    out = {r["arch_id"]: r for r in entry.plan_all(raw, answers.corpus(spark), plan.offers(spark), answers=reviews).collect()}
    assert len(out) == 5 and [i for i, r in out.items() if r["plan"]] == ["good"] and out["good"]["limitations"][-1].startswith("Linux") and out["good"]["problem"] is None
    assert out["faulty"]["instance_type"] is None and out["faulty"]["errors"] > 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="share"):
        lineage.checkpoint_folder(Session())
