"""Settings and invariants of made topologies."""

import json

import pytest
from pyspark.sql import functions as F

from meshlark import config
from meshlark.functions import addr
from meshlark.operators import contracts
from meshlark.sources import cards


def test_settings_go_from_defaults_to_the_caller(tmp_path):
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"tier": {"high": 0.8, "medium": 0.5}}))
    s = config.load(str(file), {"MESHLARK_TIER__HIGH": "0.9", "OTHER": "1"}, retrieval={"top_k": 3})
    assert (s.tier.high, s.tier.medium, s.tier.margin, s.retrieval.top_k) == (0.9, 0.5, 0.08, 3)
    with pytest.raises(KeyError):
        config.load(environment={}, tier={"hihg": 1})


def test_ids_mirrors_and_references(spark):
    ids = spark.createDataFrame([("a", "device_001"), ("a", "link_010"), ("b", "device_1"), ("b", "device_01"), ("c", "odd")], "image_id string, id string")
    assert {(r["image_id"], r["id"]): r["short"] for r in contracts.short_ids(ids).collect()} == {("a", "device_001"): "device_1", ("a", "link_010"): "link_10", ("b", "device_1"): "device_1", ("b", "device_01"): "device_01", ("c", "odd"): "odd"}
    schema = "image_id string, device_id string, ip string, prefix int, mask string, network string, version int, suffix string"
    rows = [("a", "d", "10.0.0.1", 24, None, "10.0.0.0", 4, None), ("a", "d", None, None, None, None, 4, ".1"), ("a", "e", "10.0.0.1", None, None, None, 4, None), ("a", "e", "10.0.0.2", None, None, None, 4, None), ("a", "f", None, None, None, None, 4, ".9")]
    got = {r["device_id"]: (r["ip"], r["suffix"]) for r in contracts.mirror(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"d": ("10.0.0.1", None), "e": (None, None), "f": (None, ".9")}
    devices = spark.createDataFrame([("a", "d1"), ("a", "d1"), ("a", "d2")], "image_id string, device_id string")
    links = spark.createDataFrame([("a", "l1", "d1", "d9"), ("a", "l2", "d2", "d2"), ("a", "l3", None, "d2")], "image_id string, link_id string, source string, target string")
    assert sorted((r["id"], r["problem"]) for r in contracts.reference_problems(devices, links).collect()) == [("d1", "duplicate_id"), ("l1", "unknown_device"), ("l2", "self_link"), ("l3", "missing_source")]


def test_blocks(spark):
    rows = [("10.0.0.1", 24, "255.255.255.0", "10.0.0.0", 4, None), ("10.0.0.1", 24, "255.255.0.0", "10.0.0.0", 4, "mask_does_not_match_prefix"), ("10.0.0.1", 24, None, "10.0.1.0", 4, "network_does_not_match_address"), ("10.0.0.1", 33, None, None, 4, "prefix_out_of_range"), (None, None, None, "10.0.0.0", 4, "network_without_prefix"), ("2001:db8::1", 64, "255.0.0.0", None, 6, "mask_on_ipv6"), ("2001:db8::1", 64, None, "2001:db8::", 6, None)]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, ip string, p int, m string, n string, v int")
    c = F.col
    got = df.orderBy("i").select(contracts.block_problem(c("ip"), c("p"), c("m"), c("n"), c("v"), addr.prefix_to_mask(c("p"))).alias("x")).collect()
    assert [r["x"] for r in got] == [r[5] for r in rows]


def test_cases_and_caches(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a"}\n{"id": "b"}\n')
    (tmp_path / "c.json").write_text('[{"id": "a"},\n {"id": "b"}]')
    assert all(cards.cases(spark, str(tmp_path / n), "id string").count() == 2 for n in ("c.jsonl", "c.json"))
    files = spark.createDataFrame([("f", "one"), ("g", "two")], "source string, content string")
    stored = files.where("source = 'f'").select("source", F.sha2("content", 256).alias("sha256"))
    assert [r["source"] for r in cards.fresh(stored, files).collect()] == ["g"]
