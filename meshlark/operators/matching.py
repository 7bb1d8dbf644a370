"""Spatial matching: candidate joins with a distance limit, weighted scores, and decisions that may be refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.addr import bind
from ..functions.scores import HIGH, MARGIN, MEDIUM, tier, weighted

# Preference for where a text stands to a device.
PLACES = {"below": 1.0, "above": 0.9, "right": 0.85, "left": 0.85, "inside": 0.7, "diagonal": 0.6}
#: How far from a device a text may be, in device sizes.
NAME_GAP, GROUP_GAP, ADDRESS_GAP = 0.6, 0.8, 0.9


def decide(scored: DataFrame, subjects: DataFrame, keys: list[str], key: str, high: float = HIGH, medium: float = MEDIUM, margin: float = MARGIN) -> DataFrame:
    """scored (keys, key, score), subjects (keys) -> (keys, status, winner, best, best_score, runner_up, runner_up_score).

    Candidates need a positive score.  Best below ``medium``: unresolved.  Runner-up
    at ``medium`` or more and within ``margin``: ambiguous.  Else accepted or flagged.
    Subjects without candidates come out as no_candidates.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(key).cast("string"))
    ranked = scored.where("score > 0").withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    pick = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    top = ranked.groupBy(*keys).agg(pick(key, 1).alias("best"), pick("score", 1).alias("best_score"), pick(key, 2).alias("runner_up"), pick("score", 2).alias("runner_up_score"))
    best, second = F.col("best_score"), F.col("runner_up_score")
    status = (
        F.when(best.isNull(), "no_candidates")
        .when(best < medium, "unresolved")
        .when((second >= medium) & (best - second < margin), "ambiguous")
        .otherwise(tier(best, high, medium))
    )
    out = subjects.select(*keys).distinct().join(top, keys, "left").withColumn("status", status)
    return out.select(*keys, "status", F.when(F.col("status").isin("accepted", "flagged"), F.col("best")).alias("winner"), "best", "best_score", "runner_up", "runner_up_score")


def text_device_score(text: Column, ocr: Column, box: Column, yolo: Column, max_gap: float = NAME_GAP, center_factor: float = 2.0) -> Column:
    """Score of a text for a device; NULL beyond ``max_gap`` device sizes."""
    size = G.size(box)
    limit = size * max_gap
    gap = G.gap(text, box)
    t, d = G.center(text), G.center(box)
    place = G.relative_location(text, box)
    preference = F.element_at(F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv]), place)
    across = G.clamp01(1.0 - F.abs(t["x"] - d["x"]) / (G.width(box) / 2 + G.width(text) / 2))
    along = G.clamp01(1.0 - F.abs(t["y"] - d["y"]) / (G.height(box) / 2 + G.height(text) / 2))
    align = F.when(place.isin("above", "below", "inside"), across).when(place.isin("left", "right"), along).otherwise(0.0)
    apart = F.sqrt((t["x"] - d["x"]) * (t["x"] - d["x"]) + (t["y"] - d["y"]) * (t["y"] - d["y"]))
    parts = [(0.35, 1.0 - gap / limit), (0.10, G.clamp01(1.0 - apart / (size * center_factor))), (0.10, preference), (0.20, align), (0.15, G.clamp01(ocr)), (0.10, G.clamp01(yolo))]
    return F.when(gap <= limit, weighted(parts))


def near_pairs(left: DataFrame, right: DataFrame, key: str, left_box: str, right_box: str, reach: Column, cell: float) -> DataFrame:
    """Pairs of one ``key`` whose boxes, the right one grown by ``reach``, overlap; an equi-join on grid cells.

    The grown box enters every cell it touches and the left box its centre's cell widened
    by its own half extent, so a crowded image is split over cells instead of being
    paired all with all.  Both tables need unique ``_l`` and ``_r`` columns.
    """
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    r = F.col(right_box)
    grown = right.withColumn("_x", F.explode(span(r["x1"] - reach, r["x2"] + reach))).withColumn("_y", F.explode(span(r["y1"] - reach, r["y2"] + reach)))
    b = F.col(left_box)
    spread = left.withColumn("_x", F.explode(span(b["x1"], b["x2"]))).withColumn("_y", F.explode(span(b["y1"], b["y2"])))
    pairs = spread.join(grown, [key, "_x", "_y"])
    # a pair meets in several cells: keep its first
    first = (F.greatest(F.floor(b["x1"] / cell), F.floor((r["x1"] - reach) / cell)) == F.col("_x")) & (F.greatest(F.floor(b["y1"] / cell), F.floor((r["y1"] - reach) / cell)) == F.col("_y"))
    return pairs.where(first).drop("_x", "_y")


def outside_boxes(items: DataFrame, boxes: DataFrame, key: str, box: str, tolerance: float = 0.0, cell: float = 128.0) -> DataFrame:
    """items (image_id, key, box) that no box (image_id, box) of their image holds whole."""
    around = boxes.select("image_id", F.col("box").alias("_around"))
    pairs = near_pairs(items.select("image_id", key, F.col(box).alias("_own")), around, "image_id", "_own", "_around", F.lit(tolerance), cell)
    held = pairs.where(G.contains_rect(F.col("_around"), F.col("_own"), tolerance)).select("image_id", key).distinct()
    return items.join(held, ["image_id", key], "left_anti")


def match_texts(texts: DataFrame, devices: DataFrame, max_gap: float = NAME_GAP, cell: float = 128.0) -> DataFrame:
    """texts (image_id, text_id, box, confidence), devices (image_id, device_id, box, confidence) -> decisions per text."""
    t = texts.select("image_id", "text_id", F.col("box").alias("text_box"), F.col("confidence").alias("ocr"))
    d = devices.select("image_id", "device_id", F.col("box").alias("device_box"), F.col("confidence").alias("yolo"))
    pairs = near_pairs(t, d, "image_id", "text_box", "device_box", G.size(F.col("device_box")) * max_gap, cell)
    score = text_device_score(F.col("text_box"), F.col("ocr"), F.col("device_box"), F.col("yolo"), max_gap)
    scored = pairs.withColumn("score", score).where("score is not null")
    return decide(scored, texts, ["image_id", "text_id"], "device_id")


def endpoint_score(end: Column, direction: Column, last: Column, box: Column, yolo: Column, max_gap: float = 0.6, ray: float = 1.0) -> Column:
    """Score of a cable's end for a device; NULL beyond ``max_gap`` device sizes."""
    size = G.size(box)
    away = G.point_distance(box, end)
    enters = G.ray_rect_entry(end, direction, box)
    toward = F.coalesce(G.clamp01(1.0 - enters / (size * ray)), F.lit(0.0))
    crosses = F.when(G.clip_range(last, box)[2], 1.0).otherwise(0.0)
    parts = [(0.45, 1.0 - away / (size * max_gap)), (0.30, toward), (0.10, crosses), (0.15, G.clamp01(yolo))]
    return F.when(away <= size * max_gap, weighted(parts))


def terminal(segments: Column, end: Column) -> Column:
    """struct(seg, direction): the segment end nearest to a point, the first of equals, pointing outwards."""
    both = F.flatten(F.transform(segments, lambda s, i: F.array(
        F.struct(G.dist(s["p1"], end).alias("d"), (i * 2).alias("i"), G.segment(s["p2"], s["p1"]).alias("seg")),
        F.struct(G.dist(s["p2"], end).alias("d"), (i * 2 + 1).alias("i"), G.segment(s["p1"], s["p2"]).alias("seg")),
    )))
    best = F.array_min(both)["seg"]
    return F.struct(best.alias("seg"), G.unit(best["p1"], best["p2"]).alias("direction"))


def text_height(box: Column, angle: Column) -> Column:
    vertical = (angle > 0.7853981633974483) & (angle < 2.356194490192345)
    return F.greatest(F.when(vertical, G.width(box)).otherwise(G.height(box)), F.lit(1.0))


def link_midpoint(polyline: Column, start: Column, end: Column, segments: Column) -> Column:
    n = F.size(segments).cast("double")
    mean = lambda c: F.aggregate(segments, F.lit(0.0), lambda a, s: a + (s["p1"][c] + s["p2"][c]) / 2) / n
    middle = G.point((start["x"] + end["x"]) / 2, (start["y"] + end["y"]) / 2)
    return F.when(F.size(polyline) > 0, G.polyline_midpoint(polyline)).when(start.isNotNull() & end.isNotNull(), middle).otherwise(G.point(mean("x"), mean("y")))


def label_link_score(box: Column, angle: Column, ocr: Column, segments: Column, middle: Column, device_gap: Column, max_heights: float = 3.0, extent_share: float = 0.70) -> Column:
    """Score of a network label for a cable; ``device_gap`` is the label's distance from the nearest device, NULL if there is none."""
    known = F.struct(text_height(box, angle).alias("height"), G.rect_polyline(box, segments).alias("near"), F.greatest(G.segments_length(segments), F.lit(1.0)).alias("whole"))

    def score(k: Column) -> Column:
        """``k`` and ``s`` are bound, so that what many terms use is computed once and written once."""
        away, height = k["near"]["distance"], k["height"]

        def of(s: Column) -> Column:
            length = F.greatest(s["length"], F.lit(1.0))
            over = F.greatest(F.lit(0.0), -s["t"], s["t"] - 1.0) * length
            extent = 1.0 - G.clamp01(over / (length * 0.25))
            align = extent * extent_share + s["parallel"] * (1.0 - extent_share)
            mid = G.clamp01(1.0 - G.dist(G.center(box), middle) / (k["whole"] * 0.5))
            share = F.when(away + device_gap == 0, 0.5).otherwise(away / F.when(away + device_gap > 0, away + device_gap))
            relative = F.when(device_gap.isNull(), 1.0).otherwise(G.clamp01(1.0 - share * 2.0))
            return weighted([(0.40, 1.0 - away / (height * max_heights)), (0.15, align), (0.15, mid), (0.15, relative), (0.15, G.clamp01(ocr))])

        def measured(seg: Column) -> Column:
            return F.struct(G.seg_length(seg).alias("length"), G.project_param(G.center(box), seg).alias("t"), F.abs(F.cos(G.angle_diff(G.seg_angle(seg), angle))).alias("parallel"))

        nearest = bind(F.get(segments, k["near"]["index"]), measured)
        return F.when(away <= height * max_heights, bind(nearest, of))

    return bind(known, score)


def claims(decisions: DataFrame, owner: str, subject: str, score: str, margin: float = MARGIN) -> DataFrame:
    """One owner, several claimants: the best keeps it, unless the second is within ``margin``: then none does.

    Adds ``claim``: kept, lost or tied.
    """
    w = Window.partitionBy("image_id", owner)
    order = w.orderBy(F.col(score).desc(), F.col(subject))
    rows = decisions.withColumn("_rn", F.row_number().over(order)).withColumn("_second", F.lead(score).over(order))
    rows = rows.withColumn("_tie", F.max((F.col("_rn") == 1) & F.col("_second").isNotNull() & (F.col(score) - F.col("_second") < margin)).over(w))
    return rows.withColumn("claim", F.when(F.col("_tie"), "tied").when(F.col("_rn") == 1, "kept").otherwise("lost")).drop("_rn", "_second", "_tie")


def label_networks(labels: DataFrame) -> DataFrame:
    """labels (image_id, link_id, label_id, version, network, prefix, confidence) stored on links -> one network for each link and family, or none where labels conflict."""
    w = Window.partitionBy("image_id", "link_id", "version")
    values = F.size(F.collect_set(F.struct("network", "prefix")).over(w))
    rank = F.row_number().over(w.orderBy(F.col("confidence").desc(), F.col("label_id")))
    rows = labels.withColumn("_values", values).withColumn("_rank", rank)
    return rows.withColumn("applied", (F.col("_values") == 1) & (F.col("_rank") == 1)).withColumn("conflict", F.col("_values") > 1).drop("_values", "_rank")


def duplicate_boxes(devices: DataFrame, least_iou: float = 0.7) -> DataFrame:
    """Pairs of detections of one image that overlap by ``least_iou`` or more: (image_id, kept, dropped, iou) by confidence, then id."""
    a = devices.select("image_id", F.col("device_id").alias("a"), F.col("box").alias("abox"), F.col("confidence").alias("ac"))
    b = devices.select("image_id", F.col("device_id").alias("b"), F.col("box").alias("bbox"), F.col("confidence").alias("bc"))
    pairs = near_pairs(a, b, "image_id", "abox", "bbox", F.lit(0.0), 128.0).where("ac > bc or (ac = bc and a < b)")
    return pairs.withColumn("iou", G.iou(F.col("abox"), F.col("bbox"))).where(F.col("iou") >= least_iou).select("image_id", F.col("a").alias("kept"), F.col("b").alias("dropped"), "iou")
