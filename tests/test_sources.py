"""Detector documents, cards, sinks, streams and kernels."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from meshlark.functions import geometry as G
from meshlark.operators import kernels, matching, spatial
from meshlark.sources import cards, detections, sinks
from meshlark.streaming import check_stream, documents


def test_detector_documents(spark):
    image = {"path": "a.png", "width": 100, "height": 50}
    boxes = {"image": image, "detections": [{"id": "d1", "class": "pc", "confidence": 0.9, "bbox": [10, 10, 5, 5]}, {"id": "d1", "class": "pc", "confidence": None, "bbox": [90, 10, 120, 20]}]}
    words = {"image": image, "texts": [{"id": "t1", "text": "R1", "confidence": 0.8, "polygon": [[1, 2], [5, 2], [5, 4], [1, 4]]}]}
    lines = {"image": image, "link_candidates": [{"id": "c1", "segments": [[[0, 0], [3, 4]]], "polyline": [[0, 0], [3, 4]], "path_type": "single", "start": [0, 0], "end": None, "endpoints": [], "confidence": 0.5, "quality": {"ink": 1.0}}]}
    raw = lambda d: spark.createDataFrame([("a", json.dumps(d))], "image_id string, raw string")
    d = detections.devices(raw(boxes))
    assert tuple(d.first()["box"]) == (5, 5, 10, 10)
    assert sorted(r["problem"] for r in detections.schema_errors(d, "device_id", ["class", "confidence", "box"]).collect()) == ["duplicate_id", "missing_confidence"]
    kept, warnings = detections.fit(d, detections.images(raw(boxes)))
    assert kept.agg(F.max("box.x2")).first()[0] == 100 and [r["code"] for r in warnings.collect()] == ["bbox_outside_image"]
    assert tuple(detections.texts(raw(words)).first()["box"]) == (1, 2, 5, 4)
    c = detections.cables(raw(lines)).first()
    assert tuple(c["segments"][0]["p2"]) == (3, 4) and c["end"] is None and c["quality"] == {"ink": 1.0}
    results = spark.createDataFrame([("a", [[50.0, 0.0, 60.0, 10.0], [0.0, 2.0, 10.0, 12.0]], [0.5, 0.6], ["pc", "router"])], "image_id string, boxes array<array<double>>, scores array<double>, labels array<string>")
    assert {r["device_id"]: r["class"] for r in detections.model_rows(results).collect()} == {"device_001": "router", "device_002": "pc"}
    files = spark.createDataFrame([("x", bytearray(b"ab"))], "path string, content binary")
    assert detections.detect(files, lambda: lambda b: [{"n": len(b)}], "image_id string, n long").first()["n"] == 2


def test_cards(spark):
    body = "# A\nRule-ID: R-1\nMode: all\nPhase: topology\nRelated: R-2, R-9\nSources: s1, s2\n" + "# B\nRule-ID: R-2\nMode: odd\nPhase: topology\nRelated: none\nSources: s1\n"
    files = spark.createDataFrame([("f.md", body), ("g.md", "intro\n# Long\n" + "\n".join(["x" * 99] * 40))], "source string, content string")
    chunks = cards.chunks(files)
    long = [r["text"] for r in chunks.where("heading = '# Long'").collect()]
    assert len(long) == 3 and all(len(t) <= 1800 for t in long) and "".join(long).count("x") == 3960
    records = cards.records(chunks)
    assert records.count() == 2
    assert sorted((r["rule_id"], r["problem"]) for r in cards.record_problems(records, ["R-1", "R-3"]).collect()) == [("R-2", "unknown_mode"), ("R-3", "missing_rule")]
    sources = spark.createDataFrame([("s1",)], "source_id string")
    lint = cards.lint(chunks, ["Rule-ID", "Mode", "Phase", "Related", "Sources"], r"^# [A-Z]$", sources)
    assert sorted((r["rule_id"], r["problem"]) for r in lint.collect()) == [("R-1", "unknown_related R-9"), ("R-1", "unknown_source s2")]
    assert cards.manifest(files, records).count() == 2


def test_strict_json_and_revisions(spark):
    deep = "[" * 70 + "]" * 70
    rows = [('{"b": 1, "a": [1.5, null]}', '{"a":[1.5,null],"b":1}', None), ('{"a": 1, "a": 2}', None, "invalid_json_value"), ("[NaN]", None, "invalid_json_value"), ("[1e999]", None, "invalid_json_value"), (deep, deep, "json_nesting_limit"), ("x", None, "invalid_json_value")]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    out = df.select(sinks.canonical_json("t").alias("c"), sinks.json_problem("t")["code"].alias("p"), sinks.revision(F.col("t")).alias("r")).collect()
    assert [(r["c"], r["p"]) for r in out] == [r[1:] for r in rows]
    assert out[0]["r"] == sinks.fingerprint(rows[0][1])
    stored = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.keep_first(stored, new, "k").collect()) == [(1, "a"), (2, "c")]


def test_stream_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"devices": [], "links": []}')
    q = check_stream(documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    assert sorted(r["code"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["missing_devices", "missing_links"]


def boxes(spark, rows, key):
    df = spark.createDataFrame(rows, f"image_id string, {key} string, confidence double, a double, b double, c double, d double")
    return df.select("image_id", key, "confidence", G.rect(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box"))


def test_suppression_is_greedy(spark):
    # b overlaps a and c; a is surest, so b goes and c stays
    d = boxes(spark, [("i", "a", 0.9, 0.0, 0.0, 100.0, 100.0), ("i", "b", 0.8, 10.0, 0.0, 110.0, 100.0), ("i", "c", 0.7, 25.0, 0.0, 125.0, 100.0)], "device_id")
    gone = spatial.suppress(d, matching.duplicate_boxes(d, 0.7)).collect()
    assert [(r["device_id"], r["kept_by"]) for r in gone] == [("b", "a")]


def test_decisions_can_be_refused(spark):
    scored = spark.createDataFrame([("i", "t1", "a", 0.9), ("i", "t1", "b", 0.85), ("i", "t2", "a", 0.9), ("i", "t2", "b", 0.5), ("i", "t3", "a", 0.5), ("i", "t4", "a", 0.6), ("i", "t5", "a", 0.0)], "image_id string, text_id string, device_id string, score double")
    subjects = spark.createDataFrame([("i", f"t{n}") for n in range(1, 7)], "image_id string, text_id string")
    got = {r["text_id"]: (r["status"], r["winner"]) for r in matching.decide(scored, subjects, ["image_id", "text_id"], "device_id").collect()}
    assert got == {"t1": ("ambiguous", None), "t2": ("accepted", "a"), "t3": ("unresolved", None), "t4": ("flagged", "a"), "t5": ("no_candidates", None), "t6": ("no_candidates", None)}
    held = spark.createDataFrame([("i", "d", "x", 0.9), ("i", "d", "y", 0.86), ("i", "e", "x", 0.9), ("i", "e", "y", 0.6), ("i", "f", "x", 0.7)], "image_id string, owner string, subject string, score double")
    assert sorted((r["owner"], r["subject"], r["claim"]) for r in matching.claims(held, "owner", "subject", "score").collect()) == [("d", "x", "tied"), ("d", "y", "tied"), ("e", "x", "kept"), ("e", "y", "lost"), ("f", "x", "kept")]


def test_merged_lines():
    lines = np.array([[0, 0, 50, 0], [60, 1, 120, 1], [300, 0, 350, 0], [0, 40, 0, 90]], float)
    merged = kernels.merge_segments(lines, np.zeros((0, 4)))
    assert len(merged) == 3 and max(np.hypot(*(m[2:] - m[:2])) for m in merged) >= 119
    bridged = kernels.merge_segments(lines, np.array([[118, -10, 302, 10]], float))
    assert len(bridged) == 2 and math.isclose(max(np.hypot(*(m[2:] - m[:2])) for m in bridged), 350, abs_tol=1)
    assert len(kernels.merge_segments(lines, np.zeros((0, 4)), block=1)) == 3
