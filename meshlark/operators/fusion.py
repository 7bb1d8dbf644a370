"""From detected boxes, texts and cables to devices with names, addresses and links.

Each pass takes tables and returns one; nothing is updated in place, and losers keep
their status and reason.  All joins go by image, so images are spread over tasks and never
meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import addr, ipv6, text
from ..functions import geometry as G
from ..functions.scores import combine, tier
from ..plans.lineage import cut
from ..sources.detections import number
from . import grouping, matching, spatial

STORED = ("accepted", "flagged")
ADDRESS_KINDS = ("ipv4", "ipv4_cidr", "subnet_mask", "ipv6", "ipv6_cidr")
LEAST_CABLE, MISSING_END = 0.30, 0.60
WHY = {"ambiguous": "ambiguous_device_association", "unresolved": "association_confidence_below_threshold", "no_candidates": "no_device_nearby"}


# ------------------------------------------------------------------ pass 2
def _axis(polygon: Column, box: Column) -> Column:
    p, q = F.get(polygon, F.lit(0)), F.get(polygon, F.lit(1))
    drawn = (F.size(polygon) >= 2) & (F.abs(q["x"] - p["x"]) + F.abs(q["y"] - p["y"]) > 1e-6)
    return F.when(drawn, F.pmod(F.atan2(q["y"] - p["y"], q["x"] - p["x"]), F.pi())).when(G.width(box) >= G.height(box), 0.0).otherwise(F.pi() / 2)


def _kinds(rows: DataFrame, **texts: str) -> DataFrame:
    """Adds for each name the class of a text column."""
    for name, column in texts.items():
        rows = rows.withColumn(f"_6{name}", ipv6.canonical(F.split_part(F.col(column), F.lit("/"), F.lit(1))))
        rows = rows.withColumn(name, text.classify(F.col(column), F.col(f"_6{name}"))).drop(f"_6{name}")
    return rows


def parse_texts(texts: DataFrame) -> DataFrame:
    """texts (image_id, text_id, text, confidence, box, polygon) -> (image_id, text_id, source_id, text, kind, semantic, ocr, box, angle, note).

    In order: the text as it is; without blanks around dots and slashes; token by token if
    every token has a class (then a row for each); without a leading label; unknown.
    """
    rows = texts.withColumn("norm", text.normalize("text")).withColumn("fixed", F.regexp_replace("norm", r"\s*([./])\s*", "$1"))
    label = F.regexp_extract("norm", text.LABEL, 1)
    rows = rows.withColumn("label", label).withColumn("rest", F.regexp_extract("norm", text.LABEL, 2)).withColumn("angle", _axis(F.col("polygon"), F.col("box")))
    rows = cut(_kinds(rows, direct="norm", repaired="fixed", stripped="rest"))  # read twice below, and too large an expression to be merged into what follows
    tokens = rows.where("direct = 'unknown'").select("image_id", "text_id", "norm", "box", "text", F.posexplode(F.split("norm", " ")).alias("k", "token"))
    tokens = cut(_kinds(tokens, token_kind="token"))
    b = F.col("box")
    whole = Window.partitionBy("image_id", "text_id")
    before = F.coalesce(F.sum(F.length("token") + 1).over(whole.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tokens = tokens.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("bad", F.max(F.col("token_kind") == "unknown").over(whole)).withColumn("from", before / F.length("norm"))
    tokens = tokens.where("n > 1 and not bad").withColumn("to", F.col("from") + F.length("token") / F.length("norm"))
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    upright = F.col("text").contains("\n") | (G.height(b) > G.width(b) * 1.5)
    by_line = F.col("text").contains("\n") & (lines == F.col("n"))
    lo = F.when(by_line, F.col("k") / F.col("n")).otherwise(F.col("from"))
    hi = F.when(by_line, (F.col("k") + 1) / F.col("n")).otherwise(F.col("to"))
    part = F.when(upright, G.rect(b["x1"], b["y1"] + G.height(b) * lo, b["x2"], b["y1"] + G.height(b) * hi)).otherwise(G.rect(b["x1"] + G.width(b) * lo, b["y1"], b["x1"] + G.width(b) * hi, b["y2"]))
    split = tokens.select("image_id", F.col("text_id").alias("source_id"), "k", "token", "token_kind", part.alias("part"))
    is_split = split.select("image_id", F.col("source_id").alias("text_id")).distinct().withColumn("split", F.lit(True))
    rows = rows.join(is_split, ["image_id", "text_id"], "left").withColumn("split", F.coalesce("split", F.lit(False)))
    repair = (F.col("fixed") != F.col("norm")) & F.col("repaired").isin(*ADDRESS_KINDS, "host_suffix")
    strip = F.col("stripped").isin(*ADDRESS_KINDS) & (F.lower("label").isin(*text.ADDRESS_LABELS) | ~F.col("label").rlike(text.NAME))
    way = F.when(F.col("direct") != "unknown", "direct").when(repair, "repaired").when(F.col("split"), "split").when(strip, "stripped").otherwise("unknown")
    rows = cut(rows.withColumn("way", way))
    kind = F.when(F.col("way") == "repaired", F.col("repaired")).when(F.col("way") == "stripped", F.col("stripped")).when(F.col("way") == "direct", F.col("direct")).otherwise("unknown")
    value = F.when(F.col("way") == "repaired", F.col("fixed")).when(F.col("way") == "stripped", F.col("rest")).otherwise(F.col("norm"))
    factor = F.when(F.col("way") == "repaired", text.REPAIRED).when(F.col("way") == "stripped", text.STRIPPED).otherwise(1.0)
    note = (
        F.when(F.col("way") == "repaired", "whitespace_removed_around_dot_or_slash")
        .when(F.col("way") == "stripped", "label_prefix_stripped")
        .when((F.col("way") == "unknown") & text.is_link_type(F.col("norm")), "ignored_link_type_or_interface_term")
    )
    ocr = F.col("confidence").alias("ocr")
    one = rows.where("way <> 'split'").select("image_id", "text_id", F.col("text_id").alias("source_id"), value.alias("text"), kind.alias("kind"), (text.confidence(kind) * factor).alias("semantic"), ocr, "box", "angle", note.alias("note"))
    many = split.join(rows.where("way = 'split'").select("image_id", F.col("text_id").alias("source_id"), "confidence", "angle"), ["image_id", "source_id"])
    many = many.select(
        "image_id", F.concat("source_id", F.lit("."), (F.col("k") + 1).cast("string")).alias("text_id"), "source_id", F.col("token").alias("text"), F.col("token_kind").alias("kind"),
        (text.confidence(F.col("token_kind")) * text.SPLIT).alias("semantic"), ocr, F.col("part").alias("box"), "angle", F.lit("split_from_multi_token_ocr_region").alias("note"),
    )
    return one.unionByName(many)


def addresses_of(parsed: DataFrame) -> DataFrame:
    """Adds ip, prefix, mask, network, version, suffix, network_form and height."""
    t, kind = F.col("text"), F.col("kind")
    four, six = addr.normalize_cidr(t), F.split_part(t, F.lit("/"), F.lit(1))
    rows = parsed.withColumn("_4", F.when(kind == "ipv4_cidr", four)).withColumn("_6", F.when(kind.isin("ipv6", "ipv6_cidr"), ipv6.canonical(six)))
    prefix = F.when(kind == "ipv4_cidr", F.col("_4")["prefix_length"]).when(kind == "subnet_mask", addr.mask_to_prefix(t)).when(kind == "ipv6_cidr", F.split_part(t, F.lit("/"), F.lit(2)).try_cast("int"))
    rows = rows.withColumn("prefix", prefix)
    rows = rows.withColumn("ip", F.when(kind == "ipv4", t).when(kind == "ipv4_cidr", F.col("_4")["ip_address"]).otherwise(F.col("_6")))
    rows = rows.withColumn("mask", F.when(kind == "ipv4_cidr", F.col("_4")["subnet_mask"]).when(kind == "subnet_mask", t))
    rows = rows.withColumn("network", F.when(kind == "ipv4_cidr", F.col("_4")["network_address"]).when(kind == "ipv6_cidr", ipv6.network_of("ip", "prefix")))
    version = F.when(kind.isin("ipv4", "ipv4_cidr", "subnet_mask"), 4).when(kind.isin("ipv6", "ipv6_cidr"), 6).when(kind == "host_suffix", F.when(t.startswith("::"), 6).otherwise(4))
    rows = rows.withColumn("version", version).withColumn("suffix", F.when(kind == "host_suffix", F.lower(t)))
    form = kind.isin("ipv4_cidr", "ipv6_cidr") & (F.col("ip") == F.col("network")) & (F.col("prefix") <= F.when(kind == "ipv6_cidr", 126).otherwise(30))
    return rows.withColumn("network_form", F.coalesce(form, F.lit(False))).withColumn("height", matching.text_height(F.col("box"), F.col("angle"))).drop("_4", "_6")


# ------------------------------------------------------------------ associations
def settle(decided: DataFrame, confidence: Column) -> DataFrame:
    """A spatial decision and a combined confidence -> status, device_id and confidence: both must carry it."""
    last = tier(confidence)
    kept = F.col("status").isin(*STORED)
    status = F.when(~kept, F.col("status")).when(last == "unresolved", "unresolved").when((last == "flagged") | (F.col("status") == "flagged"), "flagged").otherwise("accepted")
    out = decided.withColumn("_confidence", confidence).withColumn("status", status)
    stored = F.col("status").isin(*STORED)
    return out.withColumn("device_id", F.when(stored, F.col("winner"))).withColumn("confidence", F.when(stored, F.col("_confidence"))).drop("_confidence")


def associate(items: DataFrame, devices: DataFrame, max_gap: float) -> DataFrame:
    """items (image_id, text_id, box, ocr, semantic) -> (image_id, text_id, status, device_id, confidence, best, best_score)."""
    spots = items.select("image_id", "text_id", "box", F.col("ocr").alias("confidence"))
    decided = matching.match_texts(spots, devices, max_gap).join(items.select("image_id", "text_id", "semantic"), ["image_id", "text_id"])
    return settle(decided, combine(F.col("best_score"), F.col("semantic"))).select("image_id", "text_id", "status", "device_id", "confidence", "best", "best_score")


def place_groups(parsed: DataFrame, devices: DataFrame) -> DataFrame:
    """(image_id, text_id, group_no, status, device_id, confidence): texts in groups, and where their group belongs."""
    members = grouping.group_texts(parsed).join(parsed.select("image_id", "text_id", "box", "ocr"), ["image_id", "text_id"])
    box = G.rect(F.min("box.x1"), F.min("box.y1"), F.max("box.x2"), F.max("box.y2"))
    groups = members.groupBy("image_id", "group_no").agg(box.alias("box"), F.avg("ocr").alias("ocr"), F.first("group_confidence").alias("semantic"))
    placed = associate(groups.withColumn("text_id", F.col("group_no").cast("string")), devices, matching.GROUP_GAP)
    placed = placed.withColumn("group_no", F.col("text_id").cast("int")).drop("text_id")
    return members.select("image_id", "text_id", "group_no").join(placed.select("image_id", "group_no", "status", "device_id", "confidence"), ["image_id", "group_no"])


def _via_group(items: DataFrame, groups: DataFrame, devices: DataFrame, max_gap: float) -> DataFrame:
    """Associations through a placed group, else on their own: adds via_group."""
    placed = groups.where(F.col("status").isin(*STORED)).select("image_id", "text_id", "group_no", F.col("device_id").alias("winner"), F.col("confidence").alias("_group"), "status")
    within = settle(items.join(placed, ["image_id", "text_id"]), combine(F.col("_group"), F.col("semantic")))
    within = within.select("image_id", "text_id", "status", "device_id", "confidence", F.col("group_no").alias("via_group"))
    alone = associate(items.join(placed.select("image_id", "text_id"), ["image_id", "text_id"], "left_anti"), devices, max_gap)
    return within.unionByName(alone.select("image_id", "text_id", "status", "device_id", "confidence", F.lit(None).cast("int").alias("via_group")))


def names(parsed: DataFrame, groups: DataFrame, devices: DataFrame) -> DataFrame:
    """(image_id, text_id, status, device_id, confidence, via_group, reason): a device takes the surest name, and none if two are close."""
    found = cut(_via_group(parsed.where("kind = 'device_name'"), groups, devices, matching.NAME_GAP))
    stored = matching.claims(found.where("device_id is not null"), "device_id", "text_id", "confidence")
    tied, lost = F.col("claim") == "tied", F.col("claim") == "lost"
    reason = F.when(tied, "device_claimed_by_several_names_of_similar_score").when(lost, "device_already_named_by_higher_scoring_text")
    gone = tied | lost
    stored = stored.withColumn("reason", reason).withColumn("status", F.when(tied, "ambiguous").when(lost, "unresolved").otherwise(F.col("status")))
    stored = stored.withColumn("device_id", F.when(~gone, F.col("device_id"))).withColumn("confidence", F.when(~gone, F.col("confidence"))).drop("claim")
    why = F.element_at(F.create_map(*[F.lit(x) for kv in WHY.items() for x in kv]), F.col("status"))
    return stored.unionByName(found.where("device_id is null").withColumn("reason", why))


def bindings(parsed: DataFrame, groups: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Addresses on devices (image_id, device_id, ip, prefix, mask, network, version, confidence, text_ids), and each text's association.

    A group's address and mask count together; then, on a device with just one address without
    prefix and one stray mask, those two.
    """
    items = parsed.where(F.col("kind").isin(*ADDRESS_KINDS) & ~F.col("network_form"))
    placed = groups.where(F.col("status").isin(*STORED)).select("image_id", "text_id", "group_no", F.col("device_id").alias("winner"), F.col("confidence").alias("_group"), "status")
    within = items.join(placed, ["image_id", "text_id"]).withColumn("side", F.when(F.col("version") == 6, 6).otherwise(4))
    w = Window.partitionBy("image_id", "group_no", "side")
    parts = F.collect_list("semantic").over(w)
    joint = F.exp(F.aggregate(parts, F.log("_group"), lambda a, s: a + F.log(s)) / (F.size(parts) + 1))
    within = cut(settle(within, joint))
    grouped = within.where("device_id is not null").groupBy("image_id", "group_no", "side", "device_id").agg(
        F.max("ip").alias("ip"), F.max(F.when(F.col("kind") != "subnet_mask", F.col("prefix"))).alias("own"), F.max(F.when(F.col("kind") == "subnet_mask", F.col("text"))).alias("drawn"),
        F.max("confidence").alias("confidence"), F.array_sort(F.collect_list("text_id")).alias("text_ids"), F.max("version").alias("version"),
    )
    alone = cut(associate(items.join(placed.select("image_id", "text_id"), ["image_id", "text_id"], "left_anti"), devices, matching.ADDRESS_GAP))
    single = alone.where("device_id is not null").join(items.select("image_id", "text_id", "ip", "prefix", "kind", "text", "version"), ["image_id", "text_id"])
    single = single.select("image_id", "device_id", "ip", F.when(F.col("kind") != "subnet_mask", F.col("prefix")).alias("own"), F.when(F.col("kind") == "subnet_mask", F.col("text")).alias("drawn"), "confidence", F.array("text_id").alias("text_ids"), "version")
    every = cut(grouped.select(*single.columns).unionByName(single))
    bare, mask = (F.col("version") == 4) & F.col("ip").isNotNull() & F.col("own").isNull() & F.col("drawn").isNull(), F.col("ip").isNull() & F.col("drawn").isNotNull()
    device = Window.partitionBy("image_id", "device_id")
    every = every.withColumn("_pair", F.when((F.count_if(bare).over(device) == 1) & (F.count_if(mask).over(device) == 1), bare | mask).otherwise(F.lit(False)))
    paired = every.where("_pair").groupBy("image_id", "device_id").agg(F.max("ip").alias("ip"), F.lit(None).cast("int").alias("own"), F.max("drawn").alias("drawn"), F.exp(F.avg(F.log("confidence"))).alias("confidence"), F.array_sort(F.flatten(F.collect_list("text_ids"))).alias("text_ids"), F.lit(4).alias("version"))
    rows = every.where("not _pair").drop("_pair").unionByName(paired.select(*single.columns))
    prefix = F.coalesce("own", addr.mask_to_prefix(F.col("drawn")))
    rows = rows.withColumn("prefix", prefix).withColumn("mask", F.coalesce("drawn", F.when(F.col("version") == 4, addr.prefix_to_mask(F.col("prefix")))))
    four = addr.int_to_ip(addr.network_of(addr.ip_to_int(F.col("ip")), F.col("prefix")))
    rows = rows.withColumn("network", F.when(F.col("version") == 4, four).otherwise(ipv6.network_of("ip", "prefix")))
    texts = within.select("image_id", "text_id", "status", "device_id", "confidence").unionByName(alone.select("image_id", "text_id", "status", "device_id", "confidence"))
    return rows.select("image_id", "device_id", "ip", "prefix", "mask", "network", "version", "confidence", "text_ids"), texts


# ------------------------------------------------------------------ passes 7 to 9
def links(cables: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cables whose ends meet devices: (image_id, link_id, candidate_id, source, target, flags, …), and refused ones with their reason."""
    ends = cables.where(F.col("confidence") >= LEAST_CABLE).where("path_type not in ('branched', 'cycle')")
    ends = ends.select("image_id", "candidate_id", "segments", F.explode(F.array(F.struct(F.lit("start").alias("end"), F.col("start").alias("p")), F.struct(F.lit("end").alias("end"), F.col("end").alias("p")))).alias("e"))
    ends = ends.select("image_id", F.concat_ws("\n", "candidate_id", F.col("e.end")).alias("key"), F.col("e.p").alias("p"), matching.terminal(F.col("segments"), F.col("e.p")).alias("last")).where("p is not null")
    spots = ends.withColumn("spot", G.rect(F.col("p.x"), F.col("p.y"), F.col("p.x"), F.col("p.y")))
    d = devices.select("image_id", "device_id", F.col("box").alias("device_box"), F.col("confidence").alias("yolo"))
    pairs = matching.near_pairs(spots, d, "image_id", "spot", "device_box", G.size(F.col("device_box")) * 0.6, 128.0)
    score = matching.endpoint_score(F.col("p"), F.col("last.direction"), F.col("last.seg"), F.col("device_box"), F.col("yolo"))
    decided = matching.decide(pairs.withColumn("score", score).where("score is not null"), ends, ["image_id", "key"], "device_id")
    both = decided.select("image_id", F.split_part("key", F.lit("\n"), F.lit(1)).alias("candidate_id"), F.split_part("key", F.lit("\n"), F.lit(2)).alias("end"), "status", "winner", F.when(F.col("winner").isNotNull(), F.col("best_score")).alias("score"))
    at = lambda e, c: F.max(F.when(F.col("end") == e, F.col(c)))
    sides = both.groupBy("image_id", "candidate_id").agg(*[at(e, c).alias(f"{e}_{c}") for e in ("start", "end") for c in ("winner", "score", "status")])
    rows = cables.join(sides, ["image_id", "candidate_id"], "left")
    s, e = F.col("start_winner"), F.col("end_winner")
    reason = (
        F.when(F.col("confidence") < LEAST_CABLE, "low_geometric_confidence")
        .when(F.col("path_type").isin("branched", "cycle") | (F.col("start").isNull() & F.col("end").isNull()), "path_endpoints_undetermined")
        .when(s.isNull() & e.isNull(), "no_device_at_either_endpoint")
        .when(s == e, "both_endpoints_on_same_device")
    )
    rows = cut(rows.withColumn("reason", reason))  # for links and for what is refused
    both_known = s.isNotNull() & e.isNotNull()
    good = rows.where("reason is null").withColumn("source", F.when(both_known, F.least(s, e)).otherwise(F.coalesce(s, e))).withColumn("target", F.when(both_known, F.greatest(s, e)))
    good = good.withColumn("link_id", number("link", F.row_number().over(Window.partitionBy("image_id").orderBy("candidate_id"))))
    twins = F.when(F.col("target").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("image_id", "source", "target"))).otherwise(1)
    low = (F.coalesce("start_status", F.lit("")) == "flagged") | (F.coalesce("end_status", F.lit("")) == "flagged") | (tier(F.col("confidence")) == "flagged")
    flags = F.array_compact(F.array(F.when(low, "low_confidence"), F.when(F.col("target").isNull(), "unresolved_endpoint"), F.when(twins > 1, "parallel_link_between_same_devices")))
    missing = F.when(F.col("target").isNull(), MISSING_END).otherwise(1.0)
    good = good.withColumn("flags", flags).withColumn("overall", combine(F.col("confidence"), F.col("start_score"), F.col("end_score")) * missing)
    return good.drop("reason"), rows.where("reason is not null").select("image_id", "candidate_id", "reason")


def label_links(parsed: DataFrame, good: DataFrame, devices: DataFrame) -> DataFrame:
    """Network labels on links: (image_id, label_id, link_id, status, confidence, version, network, prefix, mask, applied, conflict)."""
    labels = parsed.where("network_form").select("image_id", F.col("text_id").alias("label_id"), "box", "angle", "ocr", "version", "network", "prefix", "mask", "height")
    near = spatial.nearest(labels.select("image_id", "label_id", "box"), devices.select("image_id", "device_id", "box"), "image_id", "label_id", "device_id")
    gap = near.select("image_id", "label_id", F.col("gap").alias("device_gap"))
    middle = matching.link_midpoint(F.col("polyline"), F.col("start"), F.col("end"), F.col("segments"))
    lines = good.select("image_id", "link_id", "segments", middle.alias("middle"))
    lines = lines.withColumn("link_box", G.rect_from_points(F.flatten(F.transform("segments", lambda s: F.array(s["p1"], s["p2"])))))
    spots = labels.join(gap, ["image_id", "label_id"], "left").withColumn("spot", G.expand(F.col("box"), F.col("height") * 3.0))
    pairs = matching.near_pairs(spots, lines, "image_id", "spot", "link_box", F.lit(0.0), 128.0)
    score = matching.label_link_score(F.col("box"), F.col("angle"), F.col("ocr"), F.col("segments"), F.col("middle"), F.col("device_gap"))
    scored = pairs.select("image_id", "label_id", "link_id", score.alias("score")).where("score is not null")
    decided = matching.decide(scored, labels, ["image_id", "label_id"], "link_id")
    decided = decided.select("image_id", "label_id", "status", F.col("winner").alias("link_id"), F.when(F.col("winner").isNotNull(), F.col("best_score")).alias("confidence"))
    rows = decided.join(labels.select("image_id", "label_id", "version", "network", "prefix", "mask"), ["image_id", "label_id"])
    on = matching.label_networks(rows.where("link_id is not null"))
    on = on.withColumn("status", F.when(F.col("conflict"), "ambiguous").otherwise(F.col("status"))).withColumn("link_id", F.when(~F.col("conflict"), F.col("link_id")))
    off = rows.where("link_id is null").withColumn("applied", F.lit(False)).withColumn("conflict", F.lit(False))
    return on.unionByName(off)


def resolve_suffixes(parsed: DataFrame, good: DataFrame, labels: DataFrame, devices: DataFrame) -> DataFrame:
    """Host suffixes: (image_id, text_id, device_id, link_id, status, reason, ip, prefix, confidence).

    A suffix belongs to a link of its own device, and takes that link's label.  Different
    suffixes of one device on one link cancel each other; of what is left, so do equal
    addresses of different devices on one link.
    """
    items = parsed.where("kind = 'host_suffix'")
    found = cut(associate(items, devices, matching.ADDRESS_GAP).where("device_id is not null").select("image_id", "text_id", "device_id", F.col("confidence").alias("device_confidence")))
    rows = found.join(items.select("image_id", "text_id", "suffix", "version", "ocr", "semantic", "box", "height"), ["image_id", "text_id"])
    end = lambda side: F.struct(F.col(f"{side}_winner").alias("d"), F.col(side).alias("p"), F.col(f"{side}_score").alias("s"))
    of = good.select("image_id", "link_id", "segments", F.col("confidence").alias("cable"), F.explode(F.array(end("start"), end("end"))).alias("e"))
    of = of.select("image_id", "link_id", "segments", "cable", F.col("e.d").alias("device_id"), F.col("e.p").alias("p"), F.col("e.s").alias("end_score")).where("device_id is not null")
    pairs = rows.join(of, ["image_id", "device_id"]).join(devices.select("image_id", "device_id", F.col("box").alias("device_box")), ["image_id", "device_id"])
    away = G.rect_polyline(F.col("box"), F.col("segments"))["distance"]
    reach = F.col("height") * 4.0
    near_end = F.coalesce(G.clamp01(1.0 - G.dist(G.center(F.col("box")), F.col("p")) / (G.size(F.col("device_box")) * 1.5)), F.lit(0.0))
    pairs = pairs.withColumn("away", away).withColumn("score", F.when(F.col("away") <= reach, G.clamp01((1.0 - F.col("away") / reach) * 0.60 + near_end * 0.40)))
    decided = matching.decide(pairs.where("score is not null").select("image_id", "text_id", "link_id", "score"), rows, ["image_id", "text_id"], "link_id")
    linked = of.select("image_id", "device_id").distinct().withColumn("has_link", F.lit(True))
    rows = rows.join(decided.select("image_id", "text_id", "status", F.col("winner").alias("link_id"), F.col("best_score").alias("link_score")), ["image_id", "text_id"]).join(linked, ["image_id", "device_id"], "left")
    nets = labels.where("applied").select("image_id", "link_id", "version", F.col("network").alias("net"), F.col("prefix").alias("net_prefix"), F.col("confidence").alias("net_confidence"))
    rows = rows.join(nets, ["image_id", "link_id", "version"], "left").join(of.select("image_id", "link_id", "device_id", "cable", "end_score"), ["image_id", "link_id", "device_id"], "left")
    four = addr.resolve_host_suffix(F.col("net"), F.col("net_prefix"), F.col("suffix"))
    rows = rows.withColumn("_4", four).withColumn("_6", ipv6.resolve_suffix("net", "net_prefix", addr.host_suffix6(F.col("suffix")).cast("long")))
    got = lambda f: F.when(F.col("version") == 4, F.col("_4")[f]).otherwise(F.col("_6")[f])
    rows = rows.withColumn("ip", got("address")).withColumn("how", got("reason")).drop("_4", "_6")
    whole = combine(F.col("ocr"), F.col("semantic"), F.col("device_confidence"), F.col("link_score"), F.col("end_score"), F.col("net_confidence"), F.col("cable"))
    rows = rows.withColumn("confidence", whole)
    reason = (
        F.when(F.col("has_link").isNull(), "device_has_no_link")
        .when(F.col("status") == "ambiguous", "suffix_link_ambiguous")
        .when(F.col("link_id").isNull(), "suffix_not_close_enough_to_any_link_of_device")
        .when(F.col("net").isNull(), "link_has_no_network_label")
        .when(F.col("how") != "resolved", F.col("how"))
        .when(tier(F.col("confidence")) == "unresolved", "combined_confidence_below_threshold")
        .otherwise("resolved")
    )
    rows = rows.withColumn("reason", reason)
    live = F.col("reason") == "resolved"
    spot = Window.partitionBy("image_id", "device_id", "link_id", "version")
    rows = rows.withColumn("reason", F.when(live & (F.size(F.collect_set(F.when(live, F.col("suffix"))).over(spot)) > 1), "multiple_different_suffixes_for_same_device_and_link").otherwise(F.col("reason")))
    live = F.col("reason") == "resolved"
    spot = Window.partitionBy("image_id", "link_id", "ip")
    rows = rows.withColumn("reason", F.when(live & (F.size(F.collect_set(F.when(live, F.col("device_id"))).over(spot)) > 1), "same_address_resolved_for_different_devices_on_link").otherwise(F.col("reason")))
    live = F.col("reason") == "resolved"
    status = F.when(live, "resolved").when(F.col("reason").isin("suffix_link_ambiguous", "multiple_different_suffixes_for_same_device_and_link", "same_address_resolved_for_different_devices_on_link"), "ambiguous").otherwise("unresolved")
    return rows.select("image_id", "text_id", "device_id", "link_id", status.alias("status"), "reason", F.when(live, F.col("ip")).alias("ip"), F.when(live, F.col("net_prefix")).alias("prefix"), "version", "confidence")


# ------------------------------------------------------------------ the whole
def fuse(devices: DataFrame, texts: DataFrame, cables: DataFrame) -> dict[str, DataFrame]:
    """All passes over many images: parsed, groups, names, bindings, links, refused, labels, suffixes, nodes, ends, edges, unresolved."""
    gone = spatial.suppress(devices, matching.duplicate_boxes(devices))
    devices = cut(devices.join(gone.select("image_id", "device_id"), ["image_id", "device_id"], "left_anti"))
    parsed = cut(addresses_of(parse_texts(texts)))
    groups = cut(place_groups(parsed, devices))
    named = cut(names(parsed, groups, devices))
    held, address_texts = bindings(parsed, groups, devices)
    held = cut(held)
    good, refused = links(cables, devices)
    good = cut(good)
    labels = cut(label_links(parsed, good, devices))
    suffixes = cut(resolve_suffixes(parsed, good, labels, devices))
    out = {"devices": devices, "parsed": parsed, "groups": groups, "names": named, "bindings": held, "links": good, "refused": refused, "labels": labels, "suffixes": suffixes}
    out["nodes"] = nodes(devices, parsed, named)
    out["addresses"] = cut(addresses(held, suffixes))
    out["ends"], out["edges"] = minimal_links(good, labels, out["addresses"])
    out["unresolved"] = unresolved(parsed, named, address_texts, held, labels, suffixes)
    return out


def nodes(devices: DataFrame, parsed: DataFrame, named: DataFrame) -> DataFrame:
    """(image_id, device_id, type, name, deduplicated): names are unique in an image; the surest keeps its own, others get (2), (3), ..."""
    kept = named.where("device_id is not null").join(parsed.select("image_id", "text_id", "text"), ["image_id", "text_id"]).select("image_id", "device_id", F.col("text").alias("name"), "confidence")
    n = F.row_number().over(Window.partitionBy("image_id", "name").orderBy(F.col("confidence").desc(), "device_id"))
    # no class of name holds a bracket, so a numbered name is never taken already
    kept = kept.withColumn("n", n).select("image_id", "device_id", F.when(F.col("n") > 1, F.concat("name", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("name"), (F.col("n") > 1).alias("deduplicated"))
    return devices.select("image_id", "device_id", F.col("class").alias("type")).join(kept, ["image_id", "device_id"], "left").withColumn("deduplicated", F.coalesce("deduplicated", F.lit(False)))


def addresses(held: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(image_id, device_id, link_id, ip, prefix, version, confidence, source): what was read, and what suffixes resolved to.

    An address read directly that a suffix gives as well, with no other prefix, is one: the resolved stays.
    """
    solved = suffixes.where("status = 'resolved'").select("image_id", "device_id", "link_id", "ip", "prefix", "version", "confidence", F.lit("host_suffix").alias("source"))
    twin = solved.select("image_id", "device_id", "ip", F.col("prefix").alias("_p")).distinct()
    read = held.where("ip is not null").select("image_id", "device_id", F.lit(None).cast("string").alias("link_id"), "ip", "prefix", "version", "confidence", F.lit("direct").alias("source"))
    same = (read["image_id"] == twin["image_id"]) & (read["device_id"] == twin["device_id"]) & (read["ip"] == twin["ip"]) & (read["prefix"].isNull() | (read["prefix"] == twin["_p"]))
    return read.join(twin, same, "left_anti").unionByName(solved)


def minimal_links(good: DataFrame, labels: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each link end's address, and each link's network, where they are certain.

    An end has the address bound to the link; else the device's one inside the link's
    network; else, on a device with one link only, its one address.  A link without a label
    takes the network that its ends agree on.
    """
    nets = labels.where("applied").select("image_id", "link_id", "version", "network", "prefix", "mask")
    ends = good.select("image_id", "link_id", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("d")), F.struct(F.lit("target").alias("side"), F.col("target").alias("d")))).alias("e"))
    ends = ends.select("image_id", "link_id", F.col("e.side").alias("side"), F.col("e.d").alias("device_id")).where("device_id is not null")
    ends = ends.withColumn("n_links", F.count(F.lit(1)).over(Window.partitionBy("image_id", "device_id")))
    mine = held.select("image_id", "device_id", F.col("link_id").alias("bound"), "ip", F.col("prefix").alias("ip_prefix"), "version")
    rows = ends.join(mine, ["image_id", "device_id"]).join(nets.select("image_id", "link_id", "version", "network", "prefix"), ["image_id", "link_id", "version"], "left")
    inside = ipv6.network_of("ip", "prefix") == F.col("network")
    rank = F.when(F.col("bound") == F.col("link_id"), 1).when(F.col("bound").isNotNull(), None).when(F.col("network").isNotNull() & inside, 2).when(F.col("network").isNull() & (F.col("n_links") == 1), 3)
    rows = rows.withColumn("rank", rank).where("rank is not null")
    best = F.min("rank").over(Window.partitionBy("image_id", "link_id", "side", "version"))
    sure = rows.withColumn("best", best).where("rank = best").groupBy("image_id", "link_id", "side", "device_id", "version").agg(F.collect_set("ip").alias("ips"), F.max("ip_prefix").alias("ip_prefix")).where(F.size("ips") == 1)
    sure = sure.select("image_id", "link_id", "side", "device_id", "version", F.col("ips")[0].alias("ip"), "ip_prefix")
    agreed = sure.where("ip_prefix is not null").withColumn("net", F.struct(ipv6.network_of("ip", "ip_prefix").alias("network"), F.col("ip_prefix").alias("prefix")))
    agreed = agreed.groupBy("image_id", "link_id", "version").agg(F.collect_set("net").alias("nets")).where(F.size("nets") == 1).select("image_id", "link_id", "version", F.col("nets")[0].alias("agreed"))
    known = nets.join(agreed, ["image_id", "link_id", "version"], "full_outer")
    edges = known.select("image_id", "link_id", "version", F.coalesce("network", F.col("agreed.network")).alias("network"), F.coalesce("prefix", F.col("agreed.prefix")).alias("prefix"))
    edges = edges.withColumn("mask", F.when(F.col("version") == 4, addr.prefix_to_mask(F.col("prefix"))))
    return sure, good.select("image_id", "link_id", "source", "target", "flags", "overall").join(edges, ["image_id", "link_id"], "left")


def unresolved(parsed: DataFrame, named: DataFrame, address_texts: DataFrame, held: DataFrame, labels: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(image_id, text_id, kind, reason): every text that ended nowhere."""
    used = held.select("image_id", F.explode("text_ids").alias("text_id"))
    why = F.element_at(F.create_map(*[F.lit(x) for kv in WHY.items() for x in kv]), F.col("status"))
    a = named.where("device_id is null").select("image_id", "text_id", F.lit("device_name").alias("kind"), "reason")
    b = address_texts.join(used, ["image_id", "text_id"], "left_anti").select("image_id", "text_id", F.lit("address").alias("kind"), F.coalesce(why, F.lit("no_association_attempted")).alias("reason"))
    lost = F.when(F.col("conflict"), "conflicting_labels_on_same_link").when(F.col("status") == "ambiguous", "ambiguous_link_association").when(F.col("status") == "unresolved", "association_confidence_below_threshold").otherwise("no_link_nearby")
    c = labels.where("link_id is null").select("image_id", F.col("label_id").alias("text_id"), F.lit("network_label").alias("kind"), lost.alias("reason"))
    d = parsed.where("kind = 'host_suffix'").select("image_id", "text_id").join(suffixes.select("image_id", "text_id"), ["image_id", "text_id"], "left_anti").select("image_id", "text_id", F.lit("host_suffix").alias("kind"), F.lit("no_device_nearby").alias("reason"))
    e = parsed.where("kind = 'unknown'").select("image_id", "text_id", F.lit("text").alias("kind"), F.lit("unclassified_text").alias("reason"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)
