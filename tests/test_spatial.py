"""Nearest boxes, suppression and grouping against plain versions that go step by step."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meshlark.functions import geometry as G
from meshlark.operators import grouping, spatial


def boxes(spark, rows, key):
    df = spark.createDataFrame(rows, f"image_id long, {key} long, a double, b double, c double, d double")
    return df.select("image_id", key, G.rect(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box"))


def square(p, q):
    dx, dy = max(0, q[0] - p[2], p[0] - q[2]), max(0, q[1] - p[3], p[1] - q[3])
    return dx * dx + dy * dy


def test_nearest_by_rings(spark):
    rng = random.Random(3)
    left, right = [], []
    for image, (n, m, span, off) in enumerate([(40, 60, 2000, 0), (30, 1, 500, 90_000), (20, 30, 40, 0), (5, 0, 100, 0), (0, 5, 100, 0), (25, 2, 3000, -50_000)]):
        box = lambda o: (x := rng.randrange(span) + o, y := rng.randrange(span), x + rng.randrange(1, 60), y + rng.randrange(1, 40))  # noqa: E731, B023
        left += [(image, i, *map(float, box(0))) for i in range(n)]
        right += [(image, 100 + i, *map(float, box(off))) for i in range(m)]
    right += [(0, 900, 0.0, 0.0, 5000.0, 4.0)]  # one that crosses many cells
    got = spatial.nearest(boxes(spark, left, "l"), boxes(spark, right, "r"), "image_id", "l", "r", k=3).collect()
    want = set()
    for image, i, *p in left:
        found = sorted((square(p, q), j) for im, j, *q in right if im == image)[:3]
        want |= {(image, i, j, n + 1, round(math.sqrt(s), 6)) for n, (s, j) in enumerate(found)}
    assert {(r["image_id"], r["l"], r["r"], r["rank"], round(r["gap"], 6)) for r in got} == want and len(got) == len(want)
    assert spatial.nearest(boxes(spark, left, "l").limit(0), boxes(spark, right, "r"), "image_id", "l", "r").count() == 0


def plain_suppress(order, edges):
    gone = {}
    for a in order:
        if a not in gone:
            for b in sorted(edges.get(a, ())):
                gone.setdefault(b, a)
    return gone


@pytest.mark.parametrize("shape", ["chain of 200", "falling chain", "crowd"])
def test_suppression_by_rounds(spark, shape, monkeypatch):
    rng = random.Random(5)
    n = {"chain of 200": 200, "falling chain": 9, "crowd": 150}[shape]
    sure = [1 - i / n if shape == "falling chain" else rng.randrange(50) / 50 for i in range(n)]
    near = [(i, i + 1) for i in range(n - 1)] if shape != "crowd" else [(i, j) for i in range(n) for j in range(i) if rng.random() < 0.05]
    rank = lambda i: (-sure[i], i)
    edges, pairs = {}, []
    for i, j in near:
        a, b = sorted((i, j), key=rank)
        edges.setdefault(a, set()).add(b)
        pairs.append((1, a, b))
    turns = []
    cut = spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: turns.append(1) or cut(df))
    devices = spark.createDataFrame([(1, i, sure[i]) for i in range(n)], "image_id long, device_id long, confidence double")
    got = spatial.suppress(devices, spark.createDataFrame(pairs, "image_id long, kept long, dropped long"))
    got = {r["device_id"]: r["kept_by"] for r in got.collect()}
    want = plain_suppress(sorted(range(n), key=rank), edges)
    assert got.keys() == want.keys()
    # each by the surest that stays beside it
    assert got == {b: min((a for a in edges if b in edges[a] and a not in want), key=rank) for b in want}
    assert shape == "falling chain" or len(turns) <= 1 + 2 * 9  # rounds grow with the logarithm
    assert spatial.suppress(devices, spark.createDataFrame([], "image_id long, kept long, dropped long")).count() == 0


FIT = {frozenset(k): v for k, v in grouping.COMPATIBLE.items()}


def plain_score(a, b):
    fit = FIT.get(frozenset((a["slot"], b["slot"]))) if a["slot"] != b["slot"] else None
    unit = (a["h"] + b["h"]) / 2
    p, q = a["box"], b["box"]
    sx, sy = max(0, q[0] - p[2], p[0] - q[2]), max(0, q[1] - p[3], p[1] - q[3])
    away = math.hypot(sx, sy)
    if fit is None or away > 2 * unit:
        return None
    mid = lambda r: ((r[0] + r[2]) / 2, (r[1] + r[3]) / 2)
    (ax, ay), (bx, by) = mid(p), mid(q)
    if sy >= sx:
        off, span = min(abs(ax - bx), abs(p[0] - q[0]), abs(p[2] - q[2])), max(p[2] - p[0], q[2] - q[0])
    else:
        off, span = abs(ay - by), max(p[3] - p[1], q[3] - q[1])
    one, two = ((ax, ay), (bx, by)) if grouping.ORDER[a["slot"]] <= grouping.ORDER[b["slot"]] else ((bx, by), (ax, ay))
    usual = two[1] > one[1] if abs(two[1] - one[1]) > unit / 2 else one[0] <= two[0]
    return 0.4 * (1 - away / (2 * unit)) + 0.3 * min(1, max(0, 1 - off / max(0.6 * span, 1))) + (0.1 if usual else 0.06) + 0.2 * fit


def plain_groups(texts):
    pairs = []
    for a in texts:
        for b in texts:
            if a["id"] < b["id"] and (s := plain_score(a, b)) is not None and s >= 0.6:
                pairs.append((-s, a["id"], b["id"]))
    by = {t["id"]: t for t in texts}
    home, made = {i: {i} for i in by}, {}
    for s, i, j in sorted(pairs):
        rival = any(-t >= -s - 0.08 and (x, y) != (i, j) and ((own in (x, y)) and by[x if own == y else y]["slot"] == by[other]["slot"]) for t, x, y in pairs for own, other in ((i, j), (j, i)))
        both = home[i] | home[j]
        slots = [by[k]["slot"] for k in both]
        if rival or home[i] is home[j] or len(set(slots)) < len(slots) or ("subnet_mask" in slots and any(by[k]["kind"] == "ipv4_cidr" for k in both)):
            continue
        made[frozenset(both)] = made.pop(frozenset(home[i]), []) + made.pop(frozenset(home[j]), []) + [-s]
        for k in both:
            home[k] = both
    return {k: (n, round(sum(made[g]) / len(made[g]), 6)) for n, g in enumerate(sorted(made, key=min)) for k in g}


def test_grouping_by_dominant_edges(spark):
    rng = random.Random(8)
    kinds = ["device_name", "ipv4", "ipv4_cidr", "subnet_mask", "ipv6", "ipv6_cidr", "unknown"]
    rows, want = [], {}
    for image in range(12):
        texts = []
        for i in range(rng.randrange(2, 14)):
            x, y, h, kind = rng.randrange(160), rng.randrange(90), rng.randrange(9, 15), rng.choice(kinds)
            box = (float(x), float(y), float(x + rng.randrange(30, 80)), float(y + h))
            rows.append((image, f"t{i:02d}", kind, False, *box, float(h)))
            if kind in grouping.SLOTS:
                texts.append({"id": f"t{i:02d}", "kind": kind, "slot": grouping.SLOTS[kind], "box": box, "h": h})
        want |= {(image, k): v for k, v in plain_groups(texts).items()}
    df = spark.createDataFrame(rows, "image_id long, text_id string, kind string, network_form boolean, a double, b double, c double, d double, height double")
    df = df.select("image_id", "text_id", "kind", "network_form", G.rect(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box"), "height")
    got = {(r["image_id"], r["text_id"]): (r["group_no"], round(r["group_confidence"], 6)) for r in grouping.group_texts(df).collect()}
    assert got == want and max(n for n, _ in want.values()) > 0
    assert grouping.group_texts(df.limit(0)).count() == 0
