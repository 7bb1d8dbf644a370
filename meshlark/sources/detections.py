"""Detector output as tables: device boxes, texts and cable candidates, one JSON document for each image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

POINT = "array<double>"
IMAGE = "struct<path: string, width: int, height: int>"
DEVICES = f"image {IMAGE}, detections array<struct<id: string, class: string, confidence: double, bbox: array<double>>>"
TEXTS = f"image {IMAGE}, texts array<struct<id: string, text: string, confidence: double, bbox: array<double>, polygon: array<{POINT}>>>"
CABLES = f"image {IMAGE}, link_candidates array<struct<id: string, segments: array<array<{POINT}>>, polyline: array<{POINT}>, path_type: string, start: {POINT}, end: {POINT}, endpoints: array<{POINT}>, confidence: double, quality: map<string, double>>>"


def _box(c: Column) -> Column:
    return F.when(F.size(c) == 4, G.rect(c[0], c[1], c[2], c[3]))


def _point(c: Column) -> Column:
    return F.when(F.size(c) == 2, G.point(c[0], c[1]))


def _points(c: Column) -> Column:
    return F.transform(c, lambda p: G.point(p[0], p[1]))


def images(raw: DataFrame, schema: str = DEVICES) -> DataFrame:
    """(image_id, raw) -> (image_id, path, width, height)."""
    return raw.select("image_id", F.from_json("raw", schema)["image"].alias("i")).select("image_id", "i.*")


def devices(raw: DataFrame) -> DataFrame:
    """(image_id, raw) -> (image_id, device_id, class, confidence, box)."""
    rows = raw.select("image_id", F.explode(F.from_json("raw", DEVICES)["detections"]).alias("d"))
    return rows.select("image_id", F.col("d.id").alias("device_id"), F.col("d.class").alias("class"), "d.confidence", _box(F.col("d.bbox")).alias("box"))


def texts(raw: DataFrame) -> DataFrame:
    """(image_id, raw) -> (image_id, text_id, text, confidence, box, polygon); a missing box comes from the polygon."""
    rows = raw.select("image_id", F.explode(F.from_json("raw", TEXTS)["texts"]).alias("t"))
    polygon = F.when(F.size("t.polygon") > 0, _points(F.col("t.polygon")))
    rows = rows.select("image_id", F.col("t.id").alias("text_id"), "t.text", "t.confidence", _box(F.col("t.bbox")).alias("box"), polygon.alias("polygon"))
    return rows.withColumn("box", F.coalesce("box", F.when(F.col("polygon").isNotNull(), G.rect_from_points(F.col("polygon")))))


def cables(raw: DataFrame) -> DataFrame:
    """(image_id, raw) -> (image_id, candidate_id, segments, polyline, path_type, start, end, endpoints, confidence, quality)."""
    rows = raw.select("image_id", F.explode(F.from_json("raw", CABLES)["link_candidates"]).alias("c"))
    segments = F.transform("c.segments", lambda s: G.segment(G.point(s[0][0], s[0][1]), G.point(s[1][0], s[1][1])))
    return rows.select(
        "image_id", F.col("c.id").alias("candidate_id"), segments.alias("segments"), _points(F.col("c.polyline")).alias("polyline"), "c.path_type",
        _point(F.col("c.start")).alias("start"), _point(F.col("c.end")).alias("end"), _points(F.col("c.endpoints")).alias("endpoints"), "c.confidence", "c.quality",
    )


def schema_errors(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(image_id, key, problem): a required value that is missing, or an id that the image has twice."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in required]
    gaps = rows.select("image_id", key, F.explode(F.array_compact(F.array(*missing))).alias("problem"))
    twice = rows.groupBy("image_id", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("image_id", key, F.lit("duplicate_id").alias("problem"))
    return gaps.unionByName(twice)


def fit(rows: DataFrame, images: DataFrame, tolerance: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Boxes clipped to their image, and warnings (image_id, code, overshoot): outside by more than ``tolerance``, or nothing left."""
    joined = rows.join(images.select("image_id", "width", "height"), "image_id")
    b = F.col("box")
    over = F.greatest(-b["x1"], -b["y1"], b["x2"] - F.col("width"), b["y2"] - F.col("height"))
    clipped = G.clip(b, F.col("width"), F.col("height"))
    joined = joined.withColumn("_over", over).withColumn("box", clipped)
    left = (G.width(F.col("box")) > 0) & (G.height(F.col("box")) > 0)
    codes = F.array_compact(F.array(F.when(F.col("_over") > tolerance, F.lit("bbox_outside_image")), F.when(~left, F.lit("bbox_empty_after_clip"))))
    warnings = joined.select("image_id", F.explode(codes).alias("code"), F.col("_over").alias("overshoot"))
    return joined.where(left).drop("_over", "width", "height"), warnings


def size_errors(*documents: DataFrame) -> DataFrame:
    """image_ids whose documents disagree on the image's size."""
    every = documents[0].select("image_id", "width", "height")
    for d in documents[1:]:
        every = every.unionByName(d.select("image_id", "width", "height"))
    return every.groupBy("image_id").agg(F.count_distinct("width", "height").alias("n")).where("n > 1").select("image_id")


def model_rows(results: DataFrame) -> DataFrame:
    """A detector's parallel arrays (image_id, boxes, scores, labels) -> a row for each box, ids in reading order."""
    rows = results.select("image_id", F.posexplode(F.arrays_zip("boxes", "scores", "labels")).alias("n", "r"))
    rows = rows.select("image_id", "n", F.col("r.labels").alias("class"), F.col("r.scores").alias("confidence"), _box(F.col("r.boxes")).alias("box"))
    order = rows.groupBy("image_id").agg(G.reading_order(F.collect_list(F.struct(F.col("n").cast("string").alias("id"), "box"))).alias("o"))
    named = order.select("image_id", F.posexplode("o").alias("place", "n")).select("image_id", F.col("n").cast("int").alias("n"), number("device", F.col("place") + 1).alias("device_id"))
    return rows.join(named, ["image_id", "n"]).select("image_id", "device_id", "class", "confidence", "box")


def number(kind: str, n: Column) -> Column:
    """``kind_001``; numbers of four digits or more keep all of them."""
    text = n.cast("string")
    return F.concat(F.lit(f"{kind}_"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def text_rows(results: DataFrame) -> DataFrame:
    """A text reader's (image_id, texts, scores, polygons) -> rows as of ``texts``; blanks and empty polygons are left out."""
    rows = results.select("image_id", F.posexplode(F.arrays_zip("texts", "scores", "polygons")).alias("n", "r"))
    rows = rows.where((F.trim("r.texts") != "") & (F.size("r.polygons") > 0))
    polygon = _points(F.col("r.polygons"))
    return rows.select("image_id", number("text", F.col("n") + 1).alias("text_id"), F.col("r.texts").alias("text"), F.col("r.scores").alias("confidence"), G.rect_from_points(polygon).alias("box"), polygon.alias("polygon"))


def detect(files: DataFrame, detector: Callable[[], Callable[[bytes], list[dict]]], schema: str) -> DataFrame:
    """files (path, content) through an injected model: ``detector`` is called once a worker, its result once an image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = detector()
        for batch in batches:
            rows = [{"image_id": p, **r} for p, c in zip(batch["path"], batch["content"], strict=True) for r in model(c)]
            if rows:
                yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(run, schema)
