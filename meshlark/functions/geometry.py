"""Plane geometry on struct Columns: points {x, y}, segments {p1, p2}, rectangles {x1, y1, x2, y2}."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segment(p1: Column, p2: Column) -> Column:
    return F.struct(p1.alias("p1"), p2.alias("p2"))


def rect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners in any order."""
    x1, y1, x2, y2 = (c.cast("double") for c in (x1, y1, x2, y2))
    return _rect(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def _rect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def rect_from_points(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return _rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def width(r: Column) -> Column:
    return r["x2"] - r["x1"]


def height(r: Column) -> Column:
    return r["y2"] - r["y1"]


def center(r: Column) -> Column:
    return point((r["x1"] + r["x2"]) / 2.0, (r["y1"] + r["y2"]) / 2.0)


def size(r: Column) -> Column:
    return F.greatest(width(r), height(r), F.lit(1.0))


def union(a: Column, b: Column) -> Column:
    return _rect(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def expand(r: Column, margin) -> Column:
    return _rect(r["x1"] - margin, r["y1"] - margin, r["x2"] + margin, r["y2"] + margin)


def shrink_ratio(r: Column, ratio: float, border: float = 0.0) -> Column:
    """NULL when nothing is left."""
    dx, dy = F.greatest(width(r) * ratio, F.lit(border)), F.greatest(height(r) * ratio, F.lit(border))
    left = _rect(r["x1"] + dx, r["y1"] + dy, r["x2"] - dx, r["y2"] - dy)
    return F.when((width(r) - dx * 2 > 0) & (height(r) - dy * 2 > 0), left)


def clip(r: Column, w: Column, h: Column) -> Column:
    zero = F.lit(0.0)
    return _rect(F.greatest(zero, r["x1"]), F.greatest(zero, r["y1"]), F.least(w.cast("double"), r["x2"]), F.least(h.cast("double"), r["y2"]))


def contains_point(r: Column, p: Column, tol=0.0) -> Column:
    return p["x"].between(r["x1"] - tol, r["x2"] + tol) & p["y"].between(r["y1"] - tol, r["y2"] + tol)


def contains_rect(r: Column, o: Column, tol=0.0) -> Column:
    return (o["x1"] >= r["x1"] - tol) & (o["y1"] >= r["y1"] - tol) & (o["x2"] <= r["x2"] + tol) & (o["y2"] <= r["y2"] + tol)


def separations(a: Column, b: Column) -> tuple[Column, Column]:
    zero = F.lit(0.0)
    return F.greatest(zero, b["x1"] - a["x2"], a["x1"] - b["x2"]), F.greatest(zero, b["y1"] - a["y2"], a["y1"] - b["y2"])


def gap(a: Column, b: Column) -> Column:
    return F.hypot(*separations(a, b))


def _length(x: Column, y: Column) -> Column:
    """As SQL writes it, so that distances that are equal there are equal here; ``hypot`` differs in the last bit."""
    return F.sqrt(x * x + y * y)


def point_distance(r: Column, p: Column) -> Column:
    zero = F.lit(0.0)
    return _length(F.greatest(r["x1"] - p["x"], zero, p["x"] - r["x2"]), F.greatest(r["y1"] - p["y"], zero, p["y"] - r["y2"]))


def iou(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    whole = width(a) * height(a) + width(b) * height(b) - inter
    return F.when(whole > 0, inter / F.when(whole > 0, whole)).otherwise(0.0)


def dist(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def seg_length(s: Column) -> Column:
    return dist(s["p1"], s["p2"])


def seg_angle(s: Column) -> Column:
    """Undirected, in [0, pi)."""
    return F.pmod(F.atan2(s["p2"]["y"] - s["p1"]["y"], s["p2"]["x"] - s["p1"]["x"]), F.pi())


def angle_diff(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.pi())
    return F.least(d, F.pi() - d)


def unit(a: Column, b: Column) -> Column:
    d = dist(a, b)
    safe = F.when(d >= EPS, d)
    return point(F.coalesce((b["x"] - a["x"]) / safe, F.lit(0.0)), F.coalesce((b["y"] - a["y"]) / safe, F.lit(0.0)))


def project_param(p: Column, s: Column) -> Column:
    """Where p falls on the segment's line: 0 at p1, 1 at p2."""
    vx, vy = s["p2"]["x"] - s["p1"]["x"], s["p2"]["y"] - s["p1"]["y"]
    square = vx * vx + vy * vy
    return F.coalesce(((p["x"] - s["p1"]["x"]) * vx + (p["y"] - s["p1"]["y"]) * vy) / F.when(square >= EPS, square), F.lit(0.0))


def point_seg_distance(p: Column, s: Column) -> Column:
    t = clamp01(project_param(p, s))
    return _length(p["x"] - s["p1"]["x"] - t * (s["p2"]["x"] - s["p1"]["x"]), p["y"] - s["p1"]["y"] - t * (s["p2"]["y"] - s["p1"]["y"]))


def point_line_distance(p: Column, s: Column) -> Column:
    vx, vy = s["p2"]["x"] - s["p1"]["x"], s["p2"]["y"] - s["p1"]["y"]
    length = F.hypot(vx, vy)
    away = F.abs((p["x"] - s["p1"]["x"]) * vy - (p["y"] - s["p1"]["y"]) * vx) / F.when(length >= EPS, length)
    return F.coalesce(away, dist(p, s["p1"]))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def segments_intersect(s: Column, t: Column) -> Column:
    """Strict crossing: touching ends do not count."""
    d1, d2 = _turn(t["p1"], t["p2"], s["p1"]), _turn(t["p1"], t["p2"], s["p2"])
    d3, d4 = _turn(s["p1"], s["p2"], t["p1"]), _turn(s["p1"], s["p2"], t["p2"])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def _slab(origin: Column, delta: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """Where origin + t * delta is between lo and hi: first t, last t, and whether it is at all when it stands still."""
    flat = F.abs(delta) < EPS
    step = F.when(~flat, delta)
    a, b = (lo - origin) / step, (hi - origin) / step
    never = flat & ((origin < lo) | (origin > hi))
    return F.when(~flat, F.least(a, b)), F.when(~flat, F.greatest(a, b)), ~never


def clip_range(s: Column, r: Column) -> tuple[Column, Column, Column]:
    """First and last parameter of the segment's part within the rectangle, and whether there is one."""
    x = _slab(s["p1"]["x"], s["p2"]["x"] - s["p1"]["x"], r["x1"], r["x2"])
    y = _slab(s["p1"]["y"], s["p2"]["y"] - s["p1"]["y"], r["y1"], r["y2"])
    first, last = F.greatest(F.lit(0.0), x[0], y[0]), F.least(F.lit(1.0), x[1], y[1])
    return first, last, x[2] & y[2] & (first <= last)


def clip_segment_to_rect(s: Column, r: Column) -> Column:
    first, last, some = clip_range(s, r)
    at = lambda t: point(s["p1"]["x"] + t * (s["p2"]["x"] - s["p1"]["x"]), s["p1"]["y"] + t * (s["p2"]["y"] - s["p1"]["y"]))
    return F.when(some, segment(at(first), at(last)))


def seg_rect_distance(s: Column, r: Column) -> Column:
    corners = [point(r[x], r[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    apart = F.least(point_distance(r, s["p1"]), point_distance(r, s["p2"]), *[point_seg_distance(c, s) for c in corners])
    return F.when(clip_range(s, r)[2], 0.0).otherwise(apart)


def ray_rect_entry(origin: Column, direction: Column, r: Column) -> Column:
    """How many times ``direction`` goes into the way to the rectangle: the distance, if its length is 1; 0 inside, NULL if the ray misses.

    A ray that only touches a corner may miss it by rounding once its direction is divided by its length.
    """
    x = _slab(origin["x"], direction["x"], r["x1"], r["x2"])
    y = _slab(origin["y"], direction["y"], r["y1"], r["y2"])
    first, last = F.greatest(F.lit(0.0), x[0], y[0]), F.least(x[1], y[1])  # greatest and least skip NULL
    still = (F.abs(direction["x"]) < EPS) & (F.abs(direction["y"]) < EPS)
    return F.when(contains_point(r, origin), 0.0).when(~still & x[2] & y[2] & (first <= last), first)


def polyline_segments(points: Column) -> Column:
    n = F.size(points)
    return F.when(n > 1, F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), segment)).otherwise(F.array().cast("array<struct<p1:struct<x:double,y:double>,p2:struct<x:double,y:double>>>"))


def segments_length(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0.0), lambda a, s: a + seg_length(s))


def polyline_length(points: Column) -> Column:
    return segments_length(polyline_segments(points))


def polyline_midpoint(points: Column) -> Column:
    """The point at half the arc length; the first point of one without length."""
    segments = polyline_segments(points)
    half = segments_length(segments) / 2.0

    def step(state: Column, s: Column) -> Column:
        length = seg_length(s)
        here = state["at"].isNull() & (state["run"] + length >= half)
        t = F.when(length > EPS, (half - state["run"]) / F.when(length > EPS, length)).otherwise(0.0)
        found = point(s["p1"]["x"] + t * (s["p2"]["x"] - s["p1"]["x"]), s["p1"]["y"] + t * (s["p2"]["y"] - s["p1"]["y"]))
        return F.struct((state["run"] + length).alias("run"), F.when(here, found).otherwise(state["at"]).alias("at"))

    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))
    found = F.aggregate(segments, start, step, lambda s: s["at"])
    return F.when(half * 2 < EPS, F.get(points, F.lit(0))).otherwise(F.coalesce(found, F.element_at(points, -1)))


def rect_polyline(r: Column, segments: Column) -> Column:
    """struct(distance, index) of the nearest segment, the first of equals; NULL for none."""
    found = F.transform(segments, lambda s, i: F.struct(seg_rect_distance(s, r).alias("distance"), i.alias("index")))
    return F.array_min(found)


def relative_location(text: Column, device: Column) -> Column:
    """Where a text stands to a device: inside if their projections overlap on both axes, diagonal if on none."""
    dx, dy = separations(text, device)
    t, d = center(text), center(device)
    return (
        F.when((dx == 0) & (dy == 0), "inside")
        .when((dx > 0) & (dy > 0), "diagonal")
        .when((dy > 0) & (t["y"] > d["y"]), "below")
        .when(dy > 0, "above")
        .when(t["x"] > d["x"], "right")
        .otherwise("left")
    )


def reading_order(items: Column, band_ratio: float = 0.5, least_band: float = 8.0) -> Column:
    """array<struct<id, box>> -> ids in reading order.

    Items go by (centre y, centre x, id); a row is anchored at its first item and holds
    those within the band of it; within rows they go by (centre x, id).
    """
    heights = F.array_sort(F.transform(items, lambda i: height(i["box"])))
    band = F.greatest(F.lit(least_band), F.get(heights, F.floor(F.size(items) / 2).cast("int")) * band_ratio)
    ordered = F.array_sort(F.transform(items, lambda i: F.struct(center(i["box"])["y"].alias("cy"), center(i["box"])["x"].alias("cx"), i["id"].alias("id"))))
    empty = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("row"), F.array().cast("array<struct<row:int,cx:double,id:string>>").alias("out"))

    def step(state: Column, i: Column) -> Column:
        fresh = state["anchor"].isNull() | (F.abs(i["cy"] - state["anchor"]) > band)
        row = state["row"] + F.when(fresh, 1).otherwise(0)
        entry = F.struct(row.alias("row"), i["cx"].alias("cx"), i["id"].cast("string").alias("id"))
        return F.struct(F.when(fresh, i["cy"]).otherwise(state["anchor"]).alias("anchor"), row.alias("row"), F.concat(state["out"], F.array(entry)).alias("out"))

    return F.aggregate(ordered, empty, step, lambda s: F.transform(F.array_sort(s["out"]), lambda x: x["id"]))
