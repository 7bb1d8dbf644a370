"""Texts that belong together: scored pairs over a grid, merged by locally dominant edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scores import weighted
from ..plans.lineage import cut
from .matching import near_pairs

# Which two kinds of text go together, and how well; the order in which they are written.
COMPATIBLE = {("device_name", "ip"): 1.0, ("ip", "subnet_mask"): 1.0, ("device_name", "subnet_mask"): 0.6, ("device_name", "ip6"): 1.0, ("ip", "ip6"): 0.9, ("ip6", "subnet_mask"): 0.8}
SLOTS = {"device_name": "device_name", "ipv4": "ip", "ipv4_cidr": "ip", "subnet_mask": "subnet_mask", "ipv6": "ip6", "ipv6_cidr": "ip6"}
ORDER = {"device_name": 0, "ip": 1, "subnet_mask": 2, "ip6": 3}
REACH, TOLERANCE, UNUSUAL, LEAST, MARGIN = 2.0, 0.6, 0.6, 0.60, 0.08
#: Bits of what a group holds: one for each slot, one for an address with a prefix.
MASK, PREFIX = 1 << ORDER["subnet_mask"], 1 << len(ORDER)


def _known(values: dict, c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.when(c.isin(*values), c))


def pair_score(a: Column, b: Column) -> Column:
    """Score of two texts {box, height, slot} that could belong together; NULL if they cannot.

    ``a`` has the smaller id.  Parts: how near they are in text heights, how well they are
    in line, whether they stand in the usual order, and how well their kinds go together.
    """
    fit = _known({f"{x} {y}": v for (x, y), v in COMPATIBLE.items()}, F.concat_ws(" ", F.least(a["slot"], b["slot"]), F.greatest(a["slot"], b["slot"])))
    unit = (a["height"] + b["height"]) / 2
    sx, sy = G.separations(a["box"], b["box"])
    away, ca, cb = F.hypot(sx, sy), G.center(a["box"]), G.center(b["box"])
    edge = lambda c: F.abs(a["box"][c] - b["box"][c])
    stacked = sy >= sx
    shift = F.when(stacked, F.least(F.abs(ca["x"] - cb["x"]), edge("x1"), edge("x2"))).otherwise(F.abs(ca["y"] - cb["y"]))
    span = F.when(stacked, F.greatest(G.width(a["box"]), G.width(b["box"]))).otherwise(F.greatest(G.height(a["box"]), G.height(b["box"])))
    in_line = G.clamp01(1.0 - shift / F.greatest(F.lit(TOLERANCE) * span, F.lit(1.0)))
    # how far right and down the one stands that is usually written second
    second = F.when(_known(ORDER, a["slot"]) <= _known(ORDER, b["slot"]), 1.0).otherwise(-1.0)
    down, right = (cb["y"] - ca["y"]) * second, (cb["x"] - ca["x"]) * second
    usual = F.when(F.abs(down) > 0.5 * unit, down > 0).otherwise(right >= 0)
    parts = [(0.40, 1.0 - away / (REACH * unit)), (0.30, in_line), (0.10, F.when(usual, 1.0).otherwise(UNUSUAL)), (0.20, fit)]
    return F.when(fit.isNotNull() & (away <= REACH * unit), weighted(parts))


def scored_pairs(texts: DataFrame, cell: float = 128.0) -> DataFrame:
    """texts (image_id, text_id, slot, height, box) -> (image_id, a, b, score): pairs that reach LEAST, a the smaller id.

    Each box is grown by its own height, as texts further apart than both heights never pair.
    """
    side = lambda n: texts.select("image_id", F.struct("text_id", "slot", "height", "box").alias(n), G.expand(F.col("box"), F.col("height") * (REACH / 2)).alias(f"_{n}"))
    pairs = near_pairs(side("l"), side("r"), "image_id", "_l", "_r", F.lit(0.0), cell).where("l.text_id < r.text_id")
    scored = pairs.select("image_id", F.col("l.text_id").alias("a"), F.col("r.text_id").alias("b"), F.col("l.slot").alias("a_slot"), F.col("r.slot").alias("b_slot"), pair_score(F.col("l"), F.col("r")).alias("score"))
    return scored.where(F.col("score") >= LEAST)


def unambiguous(pairs: DataFrame) -> DataFrame:
    """Leaves out a pair if one of its texts has another partner of the same slot that scores within MARGIN, or better."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other"), F.col("b_slot").alias("slot")), F.struct(F.col("b").alias("own"), F.col("a").alias("other"), F.col("a_slot").alias("slot")))).alias("e")
    each = pairs.select("image_id", "a", "b", "score", ends).select("image_id", "a", "b", "score", "e.*")
    w = Window.partitionBy("image_id", "own", "slot").orderBy(F.desc("score"), "other")
    # a pair's strongest rival is the best of the rest: the first, or for the first the second
    best, runner = F.first("score").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lead("score").over(w)
    rival = F.when(F.row_number().over(w) == 1, runner).otherwise(best)
    rivals = each.withColumn("rival", rival).groupBy("image_id", "a", "b").agg(F.max("rival").alias("rival"))
    return pairs.join(rivals, ["image_id", "a", "b"]).where(F.col("rival").isNull() | (F.col("rival") < F.col("score") - MARGIN)).drop("rival")


def group_texts(parsed: DataFrame, rounds: int = 1000) -> DataFrame:
    """parsed (image_id, text_id, kind, network_form, box, height) -> (image_id, text_id, group_no, group_confidence) for texts in groups.

    The best pairs of an image group first (equal scores by ids).  A pair is passed over
    if its group would hold a slot twice or a mask beside a prefix.  What a pair's turn
    decides depends on earlier pairs of its two groups alone, so in each round every pair
    that is the best left of both its groups is decided, all at once; groups then contract
    to their least text.  A group's confidence is the mean of the scores that made it, and
    groups are numbered from 0 by their least text.
    """
    texts = parsed.where(~F.col("network_form")).withColumn("slot", _known(SLOTS, F.col("kind"))).where("slot is not null").select("image_id", "text_id", "kind", "slot", "height", "box")
    bits = _known({s: 1 << n for s, n in ORDER.items()}, F.col("slot")).bitwiseOR(F.when(F.col("kind") == "ipv4_cidr", PREFIX).otherwise(0))
    holds = texts.select("image_id", F.col("text_id").alias("t"), bits.alias("bits"))
    edges = unambiguous(cut(scored_pairs(texts))).select("image_id", F.struct((-F.col("score")).alias("s"), "a", "b").alias("e"), "a", "b")
    for end in ("a", "b"):
        edges = edges.join(holds.select("image_id", F.col("t").alias(end), F.col("bits").alias(f"{end}_bits")), ["image_id", end])
    edges, merged = cut(edges), None
    for turn in range(1, rounds):
        if edges.isEmpty():
            break
        both = edges.select("image_id", "e", F.explode(F.array("a", "b")).alias("g"))
        best = both.groupBy("image_id", "g").agg(F.min("e").alias("best"))
        top = edges.join(best.select("image_id", F.col("g").alias("a"), F.col("best").alias("_p")), ["image_id", "a"]).join(best.select("image_id", F.col("g").alias("b"), F.col("best").alias("_q")), ["image_id", "b"])
        union = F.col("a_bits").bitwiseOR(F.col("b_bits"))
        fits = (F.col("a_bits").bitwiseAND(F.col("b_bits")) == 0) & ((union.bitwiseAND(F.lit(MASK)) == 0) | (union.bitwiseAND(F.lit(PREFIX)) == 0))
        decided = cut(top.where((F.col("e") == F.col("_p")) & (F.col("e") == F.col("_q"))).select("image_id", "e", F.least("a", "b").alias("into"), F.greatest("a", "b").alias("g"), union.alias("bits"), fits.alias("fits")))
        joined = decided.where("fits").select("image_id", "e", "into", "g", "bits")
        merged = joined.drop("bits") if merged is None else _moved(merged, joined).unionByName(joined.drop("bits"))
        merged = merged if turn % 5 else cut(merged)
        left = edges.join(decided.select("image_id", "e"), ["image_id", "e"], "left_anti")
        new = joined.select("image_id", F.explode(F.array(F.struct(F.col("g").alias("old"), "into", "bits"), F.struct(F.col("into").alias("old"), "into", "bits"))).alias("m")).select("image_id", "m.*")
        for end in ("a", "b"):
            to = new.select("image_id", F.col("old").alias(end), F.col("into").alias("_g"), F.col("bits").alias("_bits"))
            left = left.join(to, ["image_id", end], "left").withColumn(end, F.coalesce("_g", end)).withColumn(f"{end}_bits", F.coalesce("_bits", f"{end}_bits")).drop("_g", "_bits")
        edges = cut(left.where("a <> b"))
    else:
        raise RuntimeError(f"grouping not settled in {rounds} rounds")
    if merged is None:
        return texts.select("image_id", F.col("text_id").cast("string").alias("text_id"), F.lit(0).alias("group_no"), F.lit(0.0).alias("group_confidence")).limit(0)
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("into")) - 1
    groups = merged.groupBy("image_id", "into").agg((-F.avg("e.s")).alias("group_confidence")).withColumn("group_no", number.cast("int"))
    members = merged.select("image_id", "into", F.explode(F.array("e.a", "e.b")).alias("text_id")).distinct()
    return members.join(groups, ["image_id", "into"]).select("image_id", "text_id", "group_no", "group_confidence")


def _moved(merged: DataFrame, joined: DataFrame) -> DataFrame:
    """Earlier merges under the names of the groups that theirs have gone into."""
    to = joined.select("image_id", F.col("g").alias("into"), F.col("into").alias("_to"))
    return merged.join(to, ["image_id", "into"], "left").withColumn("into", F.coalesce("_to", "into")).drop("_to")
