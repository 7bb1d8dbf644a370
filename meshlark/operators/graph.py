"""Graph operators on topology tables: components, broadcast segments, cycles and facts, per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import addr
from ..plans.lineage import cut


def components(vertices: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """vertices (arch_id, v), edges (arch_id, a, b) -> (arch_id, v, root): the least vertex of each component.

    Alternating stars: every round hangs a vertex's larger neighbours on the least one
    it has seen, then compresses; the number of rounds grows with the logarithm of
    the component's size, and work is linear in the edges.  Vertices may be of any
    ordered type.  Edges to unknown vertices count as vertices of their own.
    """
    pairs = edges.select("arch_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).where("u <> w").distinct()
    pairs = cut(pairs)
    mark = None
    for _ in range(rounds):
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("arch_id", "u", "w").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        both = pairs.unionByName(pairs.select("arch_id", F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("arch_id", "u").agg(F.min("w").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("w > u").join(least, ["arch_id", "u"]).select("arch_id", F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w").distinct()
        least = large.groupBy("arch_id", "u").agg(F.min("w").alias("m"))
        small = large.join(least, ["arch_id", "u"])
        pairs = cut(
            small.select("arch_id", F.col("w").alias("u"), F.col("m").alias("w"))
            .unionByName(least.select("arch_id", "u", F.col("m").alias("w")))
            .where("u <> w")
            .distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select("arch_id", F.col("u").alias("v"), F.col("w").alias("root"))
    return vertices.select("arch_id", "v").distinct().join(roots, ["arch_id", "v"], "left").withColumn("root", F.coalesce("root", "v"))


def device_edges(devices: DataFrame, links: DataFrame) -> DataFrame:
    """(arch_id, a, b) between known, different devices."""
    ids = devices.where("id is not null").select("arch_id", "id").distinct()
    ends = links.select("arch_id", F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    for end in ("a", "b"):
        ends = ends.join(ids.withColumnRenamed("id", end), ["arch_id", end], "left_semi")
    return ends.select("arch_id", "a", "b")


def neighbours(devices: DataFrame, links: DataFrame) -> DataFrame:
    """(arch_id, id, other): distinct adjacency, both ways."""
    e = device_edges(devices, links)
    return e.select("arch_id", F.col("a").alias("id"), F.col("b").alias("other")).unionByName(e.select("arch_id", F.col("b").alias("id"), F.col("a").alias("other"))).distinct()


def device_components(devices: DataFrame, links: DataFrame) -> DataFrame:
    vertices = devices.where("id is not null").select("arch_id", F.col("id").alias("v"))
    return components(vertices, device_edges(devices, links))


def link_ends(devices: DataFrame, links: DataFrame) -> DataFrame:
    """(arch_id, pos, link_id, side, device, device_pos, type, layer2, net, ip, net6, ip6) for both ends of links between known devices.

    net is ``address/prefix`` as written, NULL if no address is; so are the IPv6 ones.
    """
    side = F.explode(F.array(F.lit("source"), F.lit("target"))).alias("side")
    written = lambda b: F.when(F.col(b)["network_address"]["kind"].isNotNull(), F.concat_ws("/", F.col(b)["network_address"]["text"], F.coalesce(F.col(b)["prefix_length"]["text"], F.lit("null"))))
    rows = links.select("arch_id", "pos", F.col("id").alias("link_id"), "source", "target", "network", "network6", side)
    end = lambda b: F.when(F.col("side") == "source", F.col(b)["source_ip"]).otherwise(F.col(b)["target_ip"])["text"]
    rows = rows.select(
        "arch_id", "pos", "link_id", "side", F.when(F.col("side") == "source", F.col("source")).otherwise(F.col("target")).alias("device"),
        written("network").alias("net"), end("network").alias("ip"), written("network6").alias("net6"), end("network6").alias("ip6"),
    )
    known = devices.where("id is not null").groupBy("arch_id", "id").agg(F.min_by("type", "pos").alias("type"), F.min("pos").alias("device_pos"))
    return rows.join(known.select("arch_id", F.col("id").alias("device"), "type", "device_pos"), ["arch_id", "device"]).withColumn("layer2", addr.is_layer2(F.col("type")))


def routing_layer2(ends: DataFrame) -> DataFrame:
    """(arch_id, device): switches whose own addresses lie in several networks of one family, so that they route."""
    nets = lambda net, ip: F.size(F.collect_set(F.when(F.col(ip).isNotNull(), F.coalesce(F.col(net), F.lit("")))))
    seen = ends.where("layer2").groupBy("arch_id", "device").agg(nets("net", "ip").alias("n4"), nets("net6", "ip6").alias("n6"))
    return seen.where("n4 > 1 or n6 > 1").select("arch_id", "device")


def segments(devices: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Broadcast segments: (arch_id, segment, link_id, pos) and (arch_id, segment, device, is_host, is_bridge).

    Links that meet at a switch, bridge or hub are one segment; at a switch that
    routes, only links of one network are.  Segments are numbered by their first link.
    Hosts are devices that need an address there.
    """
    ends = cut(link_ends(devices, links))
    routed = routing_layer2(ends).withColumn("routes", F.lit(True))
    ends = cut(ends.join(routed, ["arch_id", "device"], "left").withColumn("routes", F.coalesce("routes", F.lit(False))))  # read four times below
    net = F.coalesce(F.concat(F.lit("4 "), F.col("net")), F.concat(F.lit("6 "), F.col("net6")))
    # a link and the meeting points it has: a bipartite graph, so a switch with many links costs one edge for each
    spot = ends.where(F.col("layer2") & (~F.col("routes") | net.isNotNull())).select("arch_id", "pos", F.concat_ws("\n", F.col("device"), F.when(F.col("routes"), net)).alias("spot"))
    first = spot.groupBy("arch_id", "spot").agg(F.min("pos").alias("a"))
    edges = spot.join(first, ["arch_id", "spot"]).select("arch_id", "a", F.col("pos").alias("b"))
    all_links = ends.select("arch_id", F.col("pos").alias("v"))
    roots = components(all_links, edges)
    number = roots.select("arch_id", "root").distinct().withColumn("n", F.row_number().over(Window.partitionBy("arch_id").orderBy("root")))
    names = roots.join(number, ["arch_id", "root"]).select("arch_id", F.col("v").alias("pos"), F.concat(F.lit("segment_"), F.col("n").cast("string")).alias("segment"), F.col("n").alias("segment_no"))
    placed = cut(ends.join(names, ["arch_id", "pos"]))
    seg_links = placed.where("side = 'source'").select("arch_id", "segment", "segment_no", "link_id", "pos")
    clear = F.col("layer2") & ~F.col("routes")
    addressed = F.col("ip").isNotNull() | F.col("ip6").isNotNull()
    seg_devices = placed.groupBy("arch_id", "segment", "segment_no", "device").agg(
        F.max(~clear | addressed).alias("is_host"), F.max(clear).alias("is_bridge"), F.min("device_pos").alias("device_pos"), F.first("type").alias("type"), F.min("pos").alias("first_link")
    )
    return seg_links, seg_devices


def switch_cycles(devices: DataFrame, links: DataFrame) -> DataFrame:
    """(arch_id, has_cycle): a cycle of switches and bridges only; parallel links are one.

    There is a cycle just when the links outnumber the switches less the components.
    """
    switches = devices.where(F.lower("type").isin("switch", "bridge")).select("arch_id", "id", "type", "pos")
    ids = switches.select("arch_id", "id").distinct()
    inner = links.select("arch_id", F.col("source").alias("a"), F.col("target").alias("b"))
    for end in ("a", "b"):
        inner = inner.join(ids.withColumnRenamed("id", end), ["arch_id", end], "left_semi")
    inner = inner.select("arch_id", "a", "b")
    loops = inner.where("a = b").select("arch_id").distinct().withColumn("loop", F.lit(True))
    roots = components(ids.withColumnRenamed("id", "v"), inner)
    shape = roots.groupBy("arch_id").agg(F.count(F.lit(1)).alias("vertices"), F.count_distinct("root").alias("parts"))
    n = inner.where("a <> b").groupBy("arch_id").agg(F.count(F.lit(1)).alias("edges"))
    every = devices.select("arch_id").distinct().join(shape, "arch_id", "left").join(n, "arch_id", "left").join(loops, "arch_id", "left")
    zero = F.lit(0).cast("long")
    return every.select("arch_id", (F.coalesce("loop", F.lit(False)) | (F.coalesce("edges", zero) > F.coalesce("vertices", zero) - F.coalesce("parts", zero))).alias("has_cycle"))


def duplicate_lan_addresses(devices: DataFrame, links: DataFrame) -> DataFrame:
    """Warnings of one address used by different devices of one broadcast domain: (arch_id, pos, side, value, owner).

    Domains join both ends of a cable and all ports of a switch, but no ports of a
    router; so a domain is a component of links, where links meet at switches.
    """
    ends = link_ends(devices, links)
    spot = ends.where("layer2").select("arch_id", "pos", "device")
    first = spot.groupBy("arch_id", "device").agg(F.min("pos").alias("a"))
    edges = spot.join(first, ["arch_id", "device"]).select("arch_id", "a", F.col("pos").alias("b"))
    roots = components(ends.select("arch_id", F.col("pos").alias("v")), edges).withColumnRenamed("v", "pos")
    used = ends.where("ip is not null").join(roots, ["arch_id", "pos"]).withColumn("value", addr.ip_to_int(F.col("ip")))
    order = F.struct("pos", F.when(F.col("side") == "source", 0).otherwise(1))
    owner = used.where("value is not null").groupBy("arch_id", "root", "value").agg(F.min_by("device", order).alias("owner"), F.min("device").alias("lo"), F.max("device").alias("hi")).where("lo <> hi")
    return used.join(owner, ["arch_id", "root", "value"]).where("device <> owner").select("arch_id", "pos", "side", F.col("ip").alias("value"), "device", "owner")


def _number(f: Column) -> Column:
    """A JSON number; NULL for text, even if it reads like one."""
    return F.when(f["kind"].isin("BIGINT", "DECIMAL", "DOUBLE"), f["text"].try_cast("double"))


def facts(devices: DataFrame, links: DataFrame) -> DataFrame:
    """What retrieval goes by, for each document: roles, neighbours and components, as booleans and arrays.

    ``hosts_cabled`` and ``shared_switch`` go by distinct neighbours; ``hosts_linked`` and
    ``switch_links`` by links, so that two cables from one host to a switch count twice.
    """
    d = devices.where("id is not null").select("arch_id", "id", F.lower(F.coalesce("type", F.lit(""))).alias("role"), _number(F.col("network")["prefix_length"]).alias("p"))
    host, l2 = F.col("role").isin("pc", "server"), F.col("role").isin(*addr.LAYER2)
    by_role = d.groupBy("arch_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.max(F.col("p").isin(31, 32)).alias("p_device"))
    p_link = links.groupBy("arch_id").agg(F.max(_number(F.col("network")["prefix_length"]).isin(31, 32)).alias("p_link"))
    near = neighbours(devices, links)
    sides = near.join(d.select("arch_id", "id", "role"), ["arch_id", "id"]).join(d.select("arch_id", F.col("id").alias("other"), F.col("role").alias("other_role")), ["arch_id", "other"])
    other_host = F.col("other_role").isin("pc", "server")
    per = sides.groupBy("arch_id", "id", "role").agg(F.count_if(other_host).alias("hosts"))
    pairs = per.groupBy("arch_id").agg(F.max(host & (F.col("hosts") > 0)).alias("hosts_cabled"), F.max(l2 & (F.col("hosts") >= 2)).alias("shared_switch"))
    ends = links.select("arch_id", "pos", F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))).alias("e")).select("arch_id", "pos", "e.*")
    roles = d.groupBy("arch_id", "id").agg(F.first("role").alias("role"))
    ends = ends.join(roles, ["arch_id", "id"]).join(roles.select("arch_id", F.col("id").alias("other"), F.col("role").alias("other_role")), ["arch_id", "other"])
    cables = ends.groupBy("arch_id", "id", "role").agg(F.count_if(other_host).alias("cables"))
    cables = cables.groupBy("arch_id").agg(F.max(host & (F.col("cables") > 0)).alias("hosts_linked"), F.max(l2 & (F.col("cables") >= 2)).alias("switch_links"))
    alone = d.select("arch_id", "id").join(near, ["arch_id", "id"], "left_anti").groupBy("arch_id").agg(F.lit(True).alias("standalone"))
    parts = device_components(devices, links).groupBy("arch_id").agg(F.count_distinct("root").alias("components"))
    out = by_role.join(p_link, "arch_id", "left").join(pairs, "arch_id", "left").join(cables, "arch_id", "left").join(alone, "arch_id", "left").join(parts, "arch_id", "left")
    no = F.lit(False)
    return out.select(
        "arch_id", "roles", (F.coalesce("p_device", no) | F.coalesce("p_link", no)).alias("small_prefix"), F.coalesce("hosts_cabled", no).alias("hosts_cabled"),
        F.coalesce("shared_switch", no).alias("shared_switch"), F.coalesce("hosts_linked", no).alias("hosts_linked"), F.coalesce("switch_links", no).alias("switch_links"), F.coalesce("standalone", no).alias("standalone"), F.coalesce("components", F.lit(0)).alias("components"),
    )
