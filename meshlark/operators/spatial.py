"""Nearest boxes by widening rings, and suppression by rounds of local maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans.lineage import cut

#: Rounds after which a search must have ended: each doubles the ring, so this spans 2**40 cells.
ROUNDS = 40


def _cells(lo: Column, hi: Column, size: Column, wider: int = 0) -> Column:
    return F.explode(F.sequence(F.floor(lo / size) - wider, F.floor(hi / size) + wider))


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, k: int = 1) -> DataFrame:
    """left (key, left_id, box), right (key, right_id, box) -> (key, left_id, right_id, gap, rank): the k nearest boxes of the same key.

    Gaps are measured between edges, overlapping boxes have none; equal gaps go by
    right_id.  Boxes enter the cells of a grid that holds about one box a cell.  A left box looks at
    the cells around its own.  What it has not seen then is further than a cell away, so
    it is done if its k-th find is no further, or if it has seen all boxes of its key.
    The others look again on a grid of twice the cell size, so rings widen twofold and
    only as far as they must; no two boxes are paired for their key alone.  Keys without a
    right box give no rows, nor do null keys, ids or boxes.
    """
    rows = lambda df, name: df.where(F.col(key).isNotNull() & F.col(name).isNotNull() & F.col("box").isNotNull()).select(key, name, "box")
    left, right = rows(left, left_id), rows(right, right_id)
    b = F.col("box")
    area = (F.max(b["x2"]) - F.min(b["x1"])) * (F.max(b["y2"]) - F.min(b["y1"]))
    shape = cut(right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.greatest(F.sqrt(area / F.count(F.lit(1))), F.avg(F.greatest(G.width(b), G.height(b))), F.lit(1.0)).alias("_cell")))
    targets = cut(right.join(shape, key))
    open_, found = cut(left.join(shape, key)), None
    for turn in range(ROUNDS):
        size = F.col("_cell") * float(1 << turn)
        a = open_.select(key, left_id, F.col("box").alias("_a"), "_n", "_cell", size.alias("_size"))
        mine = a.withColumn("_x", _cells(F.col("_a.x1"), F.col("_a.x2"), F.col("_size"), 1)).withColumn("_y", _cells(F.col("_a.y1"), F.col("_a.y2"), F.col("_size"), 1))
        live = targets if not turn else targets.join(open_.select(key).distinct(), key, "left_semi")
        theirs = live.select(key, right_id, b.alias("_b"), size.alias("_s"))
        theirs = theirs.withColumn("_x", _cells(F.col("_b.x1"), F.col("_b.x2"), F.col("_s"))).withColumn("_y", _cells(F.col("_b.y1"), F.col("_b.y2"), F.col("_s")))
        # two boxes may share many cells: they meet in the first
        first = lambda axis: F.greatest(F.floor(F.col(f"_a.{axis}1") / F.col("_size")) - 1, F.floor(F.col(f"_b.{axis}1") / F.col("_size"))) == F.col(f"_{axis}")
        met = mine.join(theirs, [key, "_x", "_y"]).where(first("x") & first("y"))
        sx, sy = G.separations(F.col("_a"), F.col("_b"))
        met = met.select(key, left_id, right_id, "_n", "_size", (sx * sx + sy * sy).alias("_square"))
        w = Window.partitionBy(key, left_id)
        ranked = met.withColumn("rank", F.row_number().over(w.orderBy("_square", right_id))).withColumn("_seen", F.count(F.lit(1)).over(w))
        last = F.max(F.when(F.col("rank") == F.least(F.lit(k), F.col("_n")), F.col("_square"))).over(w)
        ranked = cut(ranked.withColumn("_last", last).where(F.col("rank") <= k))
        done = ranked.where((F.col("_last") <= F.col("_size") * F.col("_size")) | (F.col("_seen") == F.col("_n")))
        done = done.select(key, left_id, right_id, F.sqrt("_square").alias("gap"), "rank")
        found = done if found is None else found.unionByName(done)
        open_ = cut(open_.join(done.select(key, left_id).distinct(), [key, left_id], "left_anti"))
        if open_.isEmpty():
            return found
    raise RuntimeError(f"nearest boxes not settled in {ROUNDS} rounds")


def suppress(devices: DataFrame, overlaps: DataFrame, rounds: int = 1000) -> DataFrame:
    """devices (image_id, device_id, confidence), overlaps (image_id, kept, dropped, ...) -> (image_id, device_id, kept_by): detections to drop.

    ``kept`` is the surer of two that overlap.  The surest detection drops all that
    overlap it; what is dropped drops nothing.  That set is found by rounds: each detection
    without a surer undecided neighbour stays, and its neighbours go.  Rounds grow with the
    longest falling chain of overlaps, which is logarithmic where confidences are unrelated to
    places.  A detection is dropped by the surest that stays beside it.
    """
    edges = cut(overlaps.select("image_id", "kept", "dropped").distinct())
    every, gone = edges, None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        below = edges.select("image_id", F.col("dropped").alias("kept")).distinct()
        out = cut(edges.join(below, ["image_id", "kept"], "left_anti").select("image_id", "dropped").distinct())
        gone = out if gone is None else gone.unionByName(out)
        rest = edges.join(out, ["image_id", "dropped"], "left_anti").join(out.withColumnRenamed("dropped", "kept"), ["image_id", "kept"], "left_anti")
        edges = cut(rest)
    else:
        raise RuntimeError(f"suppression not settled in {rounds} rounds")
    if gone is None:
        return every.select("image_id", F.col("dropped").alias("device_id"), F.col("kept").alias("kept_by")).limit(0)
    # one that leaves the edges undecided lost all its surer neighbours and stays as well
    sure = devices.select("image_id", F.col("device_id").alias("kept"), "confidence")
    standing = every.join(gone.withColumnRenamed("dropped", "kept"), ["image_id", "kept"], "left_anti").join(gone, ["image_id", "dropped"], "left_semi").join(sure, ["image_id", "kept"])
    best = F.min_by("kept", F.struct((-F.col("confidence")).alias("c"), "kept"))
    return standing.groupBy("image_id", F.col("dropped").alias("device_id")).agg(best.alias("kept_by"))
