"""JSON documents through the readiness and validation rules, graphs and allocation."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from meshlark.operators import allocation, findings, graph, plan, readiness, validation
from meshlark.sources import topology


def net(ip, p=24, mask="255.255.255.0", base="10.0.0.0"):
    return {"ip_address": ip, "prefix_length": p, "subnet_mask": mask, "network_address": base}


def cable(s, t, base="10.0.0.0", p=24, mask="255.255.255.0"):
    return {"network_address": base, "prefix_length": p, "subnet_mask": mask, "source_ip": s, "target_ip": t}


GOOD = {
    "devices": [{"id": "a", "type": "pc", "name": "PC1", "network": net("10.0.0.1")}, {"id": "b", "type": "pc", "name": "PC2", "network": net("10.0.0.2")}],
    "links": [{"id": "l", "source": "a", "target": "b", "network": cable("10.0.0.1", "10.0.0.2")}],
}
SIX = {"ip_address": "2001:DB8::1", "prefix_length": 64, "network_address": "2001:db8::"}


def changed(change):
    d = copy.deepcopy(GOOD)
    change(d, d["devices"], d["links"])
    return json.dumps(d)


CASES = {
    "good": (json.dumps(GOOD), [], []),
    "list": ("[1]", ["invalid_architecture"], ["invalid_architecture"]),
    "repeated key": ('{"a": 1, "a": 2}', ["invalid_architecture"], ["invalid_architecture"]),
    "empty": ('{"devices": [], "links": []}', ["missing_devices", "missing_links"], ["missing_devices", "missing_links"]),
    "true": (changed(lambda d, v, k: v[0]["network"].update(prefix_length=True)), ["invalid_prefix_length"], ["invalid_prefix_length"]),
    "float": (changed(lambda d, v, k: v[0]["network"].update(prefix_length=24)).replace('"prefix_length": 24', '"prefix_length": 24.0', 1), ["invalid_prefix_length"], ["invalid_prefix_length"]),
    "mask": (changed(lambda d, v, k: v[0]["network"].update(subnet_mask="255.0.255.0")), ["subnet_mask_mismatch"], ["invalid_subnet_mask", "subnet_mask_mismatch"]),
    "reused": (changed(lambda d, v, k: (v[1].update(network=net("10.0.0.1")), k[0]["network"].update(target_ip="10.0.0.1"))), [], ["duplicate_ip"] * 4),
    "names": (changed(lambda d, v, k: v[1].update(name=" pc1 ")), [], ["duplicate_device_name"] * 2),
    "outside": (changed(lambda d, v, k: (v[1]["network"].update(ip_address="10.0.9.2", network_address="10.0.9.0"), k[0]["network"].update(target_ip="10.0.9.2"))), ["link_ip_outside_network"], ["link_ip_outside_network"]),
    "ghost": (changed(lambda d, v, k: k[0].update(target="zz")), ["isolated_device"] * 2 + ["unknown_device"], ["isolated_device"] * 2 + ["unknown_device"]),
    "loop": (changed(lambda d, v, k: k[0].update(target="a")), ["isolated_device"] * 2 + ["self_link"], None),
    "missing": (changed(lambda d, v, k: v[0]["network"].update(subnet_mask=None)), ["missing_subnet_mask"], ["missing_subnet_mask"]),
    "not on link": (changed(lambda d, v, k: k[0]["network"].update(source_ip="10.0.0.9")), ["device_ip_not_on_link"], ["device_ip_not_on_link"]),
    "network ip": (changed(lambda d, v, k: (v[0]["network"].update(ip_address="10.0.0.0"), k[0]["network"].update(source_ip="10.0.0.0"))), [], ["ip_is_network_address"] * 2),
    "six": (changed(lambda d, v, k: (v[0].update(network6=SIX), k[0].update(network6={"network_address": "2001:db8::", "prefix_length": 64, "source_ip": "2001:db8::1", "target_ip": "fe80::1"}))), [], ["link_ip_outside_network", "link_local_ip", "non_canonical_ip"]),
    "scalar": (changed(lambda d, v, k: (v.append(7), k.append(None))), ["invalid_device", "invalid_link"], ["invalid_device", "invalid_link"]),
    "overflow": ('{"devices": [], "links": [], "x": 1e999}', ["invalid_json_value"], ["invalid_json_value"]),
}


@pytest.fixture(scope="module")
def parsed(spark):
    raw = spark.createDataFrame([(n, t) for n, (t, _, _) in CASES.items()], "arch_id string, raw string")
    docs = topology.parse(raw)
    return docs, topology.devices(docs), topology.links(docs), topology.headers(docs)


def codes(df):
    out = {}
    for r in df.select("arch_id", "code").collect():
        out.setdefault(r["arch_id"], []).append(r["code"])
    return {k: sorted(v) for k, v in out.items()}


def test_readiness(parsed):
    _, devices, links, headers = parsed
    got = codes(readiness.check(devices, links, headers))
    for name, (_, want, _) in CASES.items():
        assert got.get(name, []) == sorted(want), name


def test_validation(parsed, spark):
    docs, devices, links, headers = parsed
    found = validation.check(devices, links, headers).persist()
    got = codes(found)
    for name, (_, _, want) in CASES.items():
        if want is not None:
            assert got.get(name, []) == sorted(want), name
    report = {r["arch_id"]: r for r in findings.summary(docs, found).collect()}
    assert report["good"]["valid"] and not report["mask"]["valid"] and report["six"]["warnings"] == 2 and report["reused"]["codes"] == {"duplicate_ip": 4}


def rows(spark, devices, links):
    """devices (id, type), links (source, target[, base]) of one document -> the two tables."""
    doc = {
        "devices": [{"id": i, "type": t, "name": i.upper(), "network": dict.fromkeys(("ip_address", "prefix_length", "subnet_mask", "network_address"))} for i, t in devices],
        "links": [{"id": f"l{n}", "source": s, "target": t, "network": cable(x[0] if x else None, x[1] if x else None, x[2] if x else None)} for n, (s, t, *x) in enumerate(links)],
    }
    docs = topology.parse(spark.createDataFrame([("d", json.dumps(doc))], "arch_id string, raw string"))
    return topology.devices(docs), topology.links(docs)


def test_components_and_cycles_of_random_graphs(spark):
    rng = random.Random(4)
    edges, want, cyclic = [], {}, {}
    for g in range(25):
        n = rng.randrange(2, 12)
        root = list(range(n))
        loop = False

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for _ in range(rng.randrange(0, 14)):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b:
                edges.append((g, f"v{a:02d}", f"v{b:02d}"))
                x, y = find(a), find(b)
                loop |= x == y
                root[max(x, y)] = min(x, y)
        want |= {(g, f"v{i:02d}"): f"v{find(i):02d}" for i in range(n)}
        cyclic[g] = loop
    vertices = spark.createDataFrame([k for k in want], "arch_id int, v string")
    e = spark.createDataFrame(edges, "arch_id int, a string, b string")
    assert {(r["arch_id"], r["v"]): r["root"] for r in graph.components(vertices, e).collect()} == want
    devices = vertices.select("arch_id", F.col("v").alias("id"), F.lit("switch").alias("type"), F.lit(0).alias("pos"))
    links = e.select("arch_id", F.col("a").alias("source"), F.col("b").alias("target"))
    assert {r["arch_id"]: r["has_cycle"] for r in graph.switch_cycles(devices, links).collect()} == cyclic


def test_segments_end_at_routers_and_split_at_routing_switches(spark):
    devices, links = rows(spark, [("r", "router"), ("s", "switch"), ("p", "pc"), ("q", "pc"), ("x", "router")], [("r", "s"), ("s", "p"), ("s", "q"), ("r", "x")])
    seg_links, seg_devices = graph.segments(devices, links)
    assert sorted((r["segment"], r["link_id"]) for r in seg_links.collect()) == [("segment_1", "l0"), ("segment_1", "l1"), ("segment_1", "l2"), ("segment_2", "l3")]
    assert sorted((r["segment"], r["device"]) for r in seg_devices.where("is_host").collect()) == [("segment_1", "p"), ("segment_1", "q"), ("segment_1", "r"), ("segment_2", "r"), ("segment_2", "x")]
    routed = [("s", "p", "10.0.1.1", "10.0.1.2", "10.0.1.0"), ("s", "q", "10.0.2.1", "10.0.2.2", "10.0.2.0")]
    devices, links = rows(spark, [("s", "switch"), ("p", "pc"), ("q", "pc")], routed)
    assert graph.segments(devices, links)[0].select("segment").distinct().count() == 2


def test_vlsm_exercise(spark):
    """LANs of 50, 20 and 5 PCs and their routers, and two router links, in 172.16.0.0/24."""
    devices, links = [], []
    for n, size in enumerate((50, 20, 5)):
        devices += [(f"r{n}", "router"), (f"s{n}", "switch"), *((f"p{n}_{i}", "pc") for i in range(size))]
        links += [(f"r{n}", f"s{n}"), *((f"s{n}", f"p{n}_{i}") for i in range(size))]
    links += [("r0", "r1"), ("r1", "r2")]
    blocks, hosts = allocation.autoaddress(*rows(spark, devices, links), "172.16.0.0", 24)
    got = sorted((r["network"], r["prefix"]) for r in blocks.collect())
    assert got == sorted([("172.16.0.0", 26), ("172.16.0.64", 27), ("172.16.0.96", 29), ("172.16.0.104", 30), ("172.16.0.108", 30)])
    given = {(r["segment"], r["device"]): r["address"] for r in hosts.collect()}
    assert given[("segment_1", "r0")] == "172.16.0.1" and len(set(given.values())) == len(given)
    small, _ = allocation.autoaddress(*rows(spark, devices, links), "172.16.0.0", 26)
    assert all(not r["fits"] and r["network"] is None for r in small.collect())


def test_ipv6_blocks(spark):
    two = rows(spark, [("r", "router"), ("s", "switch"), ("p", "pc"), ("q", "pc"), ("x", "router")], [("r", "s"), ("s", "p"), ("s", "q"), ("r", "x")])
    blocks, hosts = allocation.autoaddress6(*two)
    assert sorted((r["network"], r["prefix"]) for r in blocks.collect()) == [("2001:db8:0:1::", 64), ("2001:db8::", 64)]
    assert {(r["segment"], r["device"]): r["address"] for r in hosts.collect()}[("segment_2", "x")] == "2001:db8:0:1::2"
    tight, _ = allocation.autoaddress6(*two, segment_prefix=None)
    assert sorted((r["network"], r["prefix"]) for r in tight.collect()) == [("2001:db8::", 126), ("2001:db8::4", 126)]
    small, _ = allocation.autoaddress6(*two, prefix=64)
    assert all(not r["fits"] and r["network"] is None for r in small.collect())


def test_limitations_and_hosting(spark):
    devices, links = rows(spark, [("a", "switch"), ("b", "switch"), ("p", "pc")], [("a", "b"), ("a", "b"), ("p", "a")])
    lines = plan.limitations(devices, links).first()["limitations"]
    assert lines == [*plan.LIMITATIONS, plan.CYCLE]
    got = plan.select_hosting(devices, links, plan.offers(spark)).first()
    assert (got["required_mib"], got["instance_type"], got["refused"]) == (768, "t3a.micro", None)
    a = spark.createDataFrame([("d", "/x", "STRING", "1"), ("d", "/y", "BIGINT", "2"), ("d", "/z", "BIGINT", "3")], "arch_id string, path string, kind string, text string")
    b = spark.createDataFrame([("d", "/x", "BIGINT", "1"), ("d", "/y", "BIGINT", "5"), ("d", "/w", "BIGINT", "3")], "arch_id string, path string, kind string, text string")
    assert sorted((r["path"], r["problem"]) for r in plan.differences(a, b).collect()) == [("/w", "missing"), ("/x", "type"), ("/y", "value"), ("/z", "unexpected")]
