"""Diagrams from evidence to devices, names, addresses and links."""

import pytest
from pyspark.sql import functions as F

from meshlark.functions import geometry as G
from meshlark.operators import fusion

DEV = [("router", 100, 150, 180, 230), ("pc", 500, 150, 580, 230)]
#: Drawings: texts with their boxes; and whether there is a cable.
CASES = {
    "suffixes": ([("R1", 125, 232, 155, 246), ("PC1", 525, 232, 555, 246), (".1", 185, 170, 200, 184), (".2", 478, 170, 493, 184), ("192.168.1.0/24", 290, 165, 390, 179)], True),
    "labels": ([("R1", 125, 232, 155, 246), ("10.0.0.1/24", 95, 248, 185, 262), ("PC1", 525, 232, 555, 246), ("10.0.0.2", 505, 248, 575, 262), ("255.255.255.0", 495, 264, 585, 278)], True),
    "no cable": ([("R1", 125, 232, 155, 246), (".1", 185, 170, 200, 184)], False),
    "far": ([("R9", 700, 390, 730, 399), ("hello world", 300, 300, 380, 314), ("GigabitEthernet0/1", 300, 200, 400, 214)], True),
    "repairs": ([("192.168.1. 7/24", 95, 235, 185, 249), ("PC1 10.0.0.9/24", 495, 235, 585, 249)], True),
}


@pytest.fixture(scope="module")
def fused(spark):
    devices, texts, cables = [], [], []
    for image, (labels, cable) in CASES.items():
        devices += [(image, f"device_{n:03d}", c, 0.95, *map(float, b)) for n, (c, *b) in enumerate(DEV, 1)]
        texts += [(image, f"text_{n:03d}", t, 0.98, *map(float, b)) for n, (t, *b) in enumerate(labels, 1)]
        if cable:
            cables.append((image, "cable_001", 180.0, 190.0, 500.0, 190.0, 0.9))
    box = G.rect(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box")
    four = "a double, b double, c double, d double"
    d = spark.createDataFrame(devices, f"image_id string, device_id string, class string, confidence double, {four}").select("image_id", "device_id", "class", "confidence", box)
    t = spark.createDataFrame(texts, f"image_id string, text_id string, text string, confidence double, {four}").select("image_id", "text_id", "text", "confidence", box, F.lit(None).cast("array<struct<x: double, y: double>>").alias("polygon"))
    p, q = G.point(F.col("a"), F.col("b")), G.point(F.col("c"), F.col("d"))
    c = spark.createDataFrame(cables, f"image_id string, candidate_id string, {four}, confidence double").select("image_id", "candidate_id", "confidence", F.array(G.segment(p, q)).alias("segments"), F.array(p, q).alias("polyline"), F.lit("single").alias("path_type"), p.alias("start"), q.alias("end"))
    return fusion.fuse(d, t, c)


def rows(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["image_id"], set()).add(tuple(r[c] for c in cols))
    return out


def test_names_and_links(fused):
    named = rows(fused["nodes"].where("name is not null"), "device_id", "name")
    assert named["suffixes"] == named["labels"] == {("device_001", "R1"), ("device_002", "PC1")}
    assert named["no cable"] == {("device_001", "R1")} and "far" not in named and ("device_002", "PC1") in named["repairs"]
    assert rows(fused["links"], "link_id", "source", "target")["suffixes"] == {("link_001", "device_001", "device_002")}
    assert "no cable" not in rows(fused["links"], "link_id")


def test_suffixes_take_the_links_label(fused):
    assert rows(fused["suffixes"].where("status = 'resolved'"), "device_id", "ip", "prefix")["suffixes"] == {("device_001", "192.168.1.1", 24), ("device_002", "192.168.1.2", 24)}
    assert rows(fused["suffixes"], "reason")["no cable"] == {("device_has_no_link",)}
    assert rows(fused["ends"], "side", "ip")["suffixes"] == {("source", "192.168.1.1"), ("target", "192.168.1.2")}
    assert rows(fused["edges"], "network", "prefix", "mask")["suffixes"] == {("192.168.1.0", 24, "255.255.255.0")}


def test_direct_addresses(fused):
    held = rows(fused["bindings"], "device_id", "ip", "prefix", "network")
    assert held["labels"] == {("device_001", "10.0.0.1", 24, "10.0.0.0"), ("device_002", "10.0.0.2", 24, "10.0.0.0")}
    assert held["repairs"] == {("device_001", "192.168.1.7", 24, "192.168.1.0"), ("device_002", "10.0.0.9", 24, "10.0.0.0")}
    assert rows(fused["ends"], "side", "ip")["labels"] == {("source", "10.0.0.1"), ("target", "10.0.0.2")}
    assert rows(fused["edges"], "network", "prefix")["labels"] == {("10.0.0.0", 24)}


def test_what_ends_nowhere_has_a_reason(fused):
    lost = rows(fused["unresolved"], "kind", "reason")
    assert lost["far"] == {("device_name", "no_device_nearby"), ("text", "unclassified_text")}
    assert "suffixes" not in lost and "labels" not in lost
    notes = rows(fused["parsed"].where("note is not null"), "text", "note")
    assert ("192.168.1.7/24", "whitespace_removed_around_dot_or_slash") in notes["repairs"] and ("PC1", "split_from_multi_token_ocr_region") in notes["repairs"]
    assert ("GigabitEthernet0/1", "ignored_link_type_or_interface_term") in notes["far"]
