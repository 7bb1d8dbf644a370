"""Retrieval of cards for topologies, plans and reviews."""

import json

import pytest
from pyspark.sql import functions as F

from meshlark.operators import graph, plan, review, search
from meshlark.sources import cards as card_source
from meshlark.sources import topology

from .test_documents import GOOD, cable, net

LAN = {
    "devices": [{"id": "s", "type": "Switch", "name": "S", "network": net(None, None, None, None)}, *({"id": f"p{n}", "type": "pc", "name": f"P{n}", "network": net(f"10.0.0.{n}")} for n in (1, 2)), {"id": "x", "type": "router", "name": "X", "network": net("10.9.0.1", 32, "255.255.255.255", "10.9.0.1")}],
    "links": [{"id": f"l{n}", "source": f"p{n}", "target": "s", "network": cable(f"10.0.0.{n}", None)} for n in (1, 2)],
}
NOISE = json.loads(json.dumps(LAN).replace('"name": "P', '"note": "ospf http", "name": "Q'))


@pytest.fixture(scope="module")
def tables(spark):
    docs = topology.parse(spark.createDataFrame([("pair", json.dumps(GOOD)), ("lan", json.dumps(LAN)), ("noise", json.dumps(NOISE))], "arch_id string, raw string"))
    return topology.devices(docs), topology.links(docs)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(r, f"# {r}\nRule-ID: {r}\nMode: all\n\nrequired card", "all", "topology") for r in (*search.ALWAYS, "L2-001", "L2-003", "ROUTE-001")]
    rows += [(r, f"{r} example", "all", "topology") for r in ("EX-PC-DIRECT", "EX-LAN", "EX-PREFIX31", "EX-STANDALONE", "EX-ISOLATED")]
    rows += [("T-1", "switch chain bridge STP loop", "all", "topology"), ("T-2", "same switch same VLAN local ping ARP", "behavioral_lab", "topology"), ("T-3", "two directly cabled PCs local traffic peer", "all", "topology"), ("T-4", "unrelated words", "all", "topology"), ("T-5", "switch chain bridge STP loop switching paths", "cloud_native", "topology"), ("T-6", "ospf", "all", "configuration")]
    return spark.createDataFrame(rows, "rule_id string, text string, mode string, phase string")


def test_retrieval_goes_by_the_graph(tables, corpus):
    got = {}
    for r in search.retrieve(corpus, *tables).orderBy("arch_id", "place").collect():
        got.setdefault(r["arch_id"], []).append(r["rule_id"])
    assert got["pair"][:12] == list(search.ALWAYS) and "EX-PC-DIRECT" in got["pair"] and got["pair"][-2] == "T-3"
    assert got["lan"][12:-2] == ["L2-001", "L2-003", "ROUTE-001", "EX-LAN", "EX-PREFIX31", "EX-STANDALONE", "EX-ISOLATED"]
    assert set(got["lan"][-2:]) == {"T-1", "T-2"} and got["noise"] == got["lan"]
    facts = {r["arch_id"]: r for r in graph.facts(*tables).collect()}
    assert facts["lan"]["components"] == 2 and facts["lan"]["roles"] == ["pc", "router", "switch"]


def test_bm25_is_the_formula(spark):
    import math

    docs = ["a b b c", "b", "", "c c c a"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    q = spark.createDataFrame([(0, "B b x c")], "query_id int, text string")
    got = {r["doc_id"]: r["score"] for r in search.bm25(df, q).collect()}
    bags = [d.split() for d in docs]
    avg = sum(map(len, bags)) / 4
    for i, bag in enumerate(bags):
        want = 0.0
        for t in ("b", "c"):
            n, tf = sum(t in b for b in bags), bag.count(t)
            want += math.log(1 + (4 - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / avg)) if tf else 0
        assert math.isclose(got.get(i, 0.0), want)
    pairs = spark.createDataFrame([(0, 0, "x y", "x y z"), (0, 1, "x y", "x")], "query_id int, doc_id int, query_text string, text string")
    assert search.rerank(pairs, search.token_overlap, 1).first()["doc_id"] == 0
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert [(r["vec_id"], r["score"]) for r in search.dense_top_k(vectors, asked, 5).orderBy("rank").collect()] == [(0, 1.0), (1, 0.0)]


def test_plans_and_reviews(spark, tables, corpus):
    devices, links = tables
    hosting = plan.select_hosting(devices, links, plan.offers(spark))
    plans = review.cloud_plans(devices, links, hosting).persist()
    doc = json.loads({r["arch_id"]: r["plan"] for r in plans.collect()}["pair"])
    end = doc["networking"]["links"][0]["source"]
    assert (end["device_id"], end["ip_address"], end["prefix_length"]) == ("a", "10.0.0.1", 24)
    assert doc["configuration_targets"][0]["interface_refs"] == [end["interface_id"]] and doc["device_mapping"][0]["network"]["subnet_mask"] == "255.255.255.0"
    assert plan.differences(review.leaves(plans), review.leaves(plans)).count() == 0
    changed = plans.withColumn("plan", F.replace("plan", F.lit('"provider":"aws"'), F.lit('"provider":"x"')))
    assert {r["path"] for r in plan.differences(review.leaves(changed), review.leaves(plans)).collect()} == {"/provider"}
    contexts = review.contexts(devices, links, hosting, search.retrieve(corpus, devices, links), corpus)
    rows = {r["arch_id"]: r for r in review.budgets(contexts, card_source.token_count).collect()}
    seen = json.loads(rows["pair"]["context"])
    assert seen["topology"]["links"][0]["source_ip_address"] == "10.0.0.1" and seen["knowledge"][0]["text"] == "required card" and "PC1" not in rows["pair"]["context"]
    assert rows["pair"]["fits"] and rows["pair"]["tokens"] > review.COMPLETION
    option = review.OPTIONS[0]
    replies = {"ok": {"rule_ids": ["CORE-001"], "limitations": [option]}, "x": {"rule_ids": [], "limitations": []}, "y": {"rule_ids": ["NO"], "limitations": []}, "z": {"rule_ids": ["CORE-001"], "limitations": ["made up"]}, "w": {"rule_ids": ["CORE-001"], "limitations": [], "plan": 1}}
    texts = [(k, json.dumps(v)) for k, v in replies.items()] + [("j", "{"), ("l", "[1]")]
    answers = spark.createDataFrame(texts, "arch_id string, content string").withColumn("rule_ids", F.array(F.lit("CORE-001"))).withColumn("options", F.array(F.lit(option)))
    problems = review.answer_problems(answers)
    assert {r["arch_id"]: r["problem"] for r in problems.collect()} == {"ok": None, "x": "no_rule_cited", "y": "unknown_rule", "z": "unknown_limitation", "w": "unexpected_section", "j": "invalid_json", "l": "not_an_object"}
    required = spark.createDataFrame([("ok", ["first"])], "arch_id string, limitations array<string>")
    assert review.merged_limitations(required, problems).first()["limitations"] == ["first", option]
    assert review.review(contexts.where("arch_id = 'pair'"), lambda c: str(len(c))).first()["content"].isdigit()
    cases = spark.createDataFrame([("pair", ["CORE-001", "EX-LAN"], ["EX-PC-DIRECT"])], "arch_id string, required array<string>, forbidden array<string>")
    got = review.recall(search.retrieve(corpus, devices, links), cases).first()
    assert (got["recall"], got["leaked"]) == (0.5, ["EX-PC-DIRECT"])
