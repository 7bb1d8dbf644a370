"""Address allocation: VLSM blocks as a running sum, and host addresses by role."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import addr, ipv6
from ..plans.lineage import cut
from ..sources.topology import typed_block
from .graph import segments

# Who gets the first addresses of a segment.
ROLE_ORDER = {"router": 0, "firewall": 1, "server": 2, "switch": 3, "bridge": 3, "hub": 3}


def vlsm(needs: DataFrame, base: int, prefix: int) -> DataFrame:
    """needs (arch_id, segment_no, prefix) -> with ``network`` (BIGINT), packed from ``base``/``prefix``, and ``fits``.

    Largest blocks first, then by segment number.  Sizes are descending powers of two, so
    the running sum of sizes keeps every block aligned and no fix-up is needed.  A document
    whose blocks exceed the base gets ``fits`` false and NULL networks.
    """
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(32) - F.col("prefix")).cast("int"))
    order = Window.partitionBy("arch_id").orderBy("prefix", "segment_no")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum(size).over(Window.partitionBy("arch_id"))
    fits = whole <= (1 << (32 - prefix))
    return needs.withColumn("fits", fits).withColumn("network", F.when(F.col("fits"), F.lit(base) + before))


def role_order(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLE_ORDER.items() for x in kv])
    role = F.lower(kind)
    return F.coalesce(F.element_at(known, F.when(role.isin(*ROLE_ORDER), role)), F.lit(4))


def segment_needs(seg_devices: DataFrame) -> DataFrame:
    """(arch_id, segment, segment_no, hosts, prefix): the smallest IPv4 block for each segment's hosts."""
    needs = seg_devices.groupBy("arch_id", "segment", "segment_no").agg(F.count_if("is_host").alias("hosts"))
    return needs.withColumn("prefix", addr.smallest_prefix(F.greatest("hosts", F.lit(1))))


def _place(seg_devices: DataFrame, base: str, prefix: int) -> tuple[DataFrame, DataFrame]:
    start = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
    if start % (1 << (32 - prefix)):
        raise ValueError(f"{base}/{prefix} is not a network")
    blocks = vlsm(segment_needs(seg_devices), start, prefix)
    rank = F.row_number().over(Window.partitionBy("arch_id", "segment").orderBy(role_order(F.col("type")), "device_pos"))
    hosts = seg_devices.where("is_host").withColumn("n", rank).join(blocks.select("arch_id", "segment", "network"), ["arch_id", "segment"])
    given = hosts.select("arch_id", "segment", "device", addr.int_to_ip(F.col("network") + F.col("n")).alias("address"))
    plan = blocks.select(
        "arch_id", "segment", addr.int_to_ip(F.col("network")).alias("network"), "prefix", addr.prefix_to_mask(F.col("prefix")).alias("mask"), addr.usable_hosts(F.col("prefix")).alias("usable"), "hosts", "fits"
    )
    return plan, given


def autoaddress(devices: DataFrame, links: DataFrame, base: str = "192.168.0.0", prefix: int = 16) -> tuple[DataFrame, DataFrame]:
    """A fresh IPv4 plan: (arch_id, segment, network, prefix, mask, usable, hosts, fits) and (arch_id, segment, device, address)."""
    return _place(segments(devices, links)[1], base, prefix)


def readdress(devices: DataFrame, links: DataFrame, base: str = "192.168.0.0", prefix: int = 16) -> tuple[DataFrame, DataFrame]:
    """Devices and links with every IPv4 block written anew: ``autoaddress`` put back into the documents.

    A link has its segment's network and its ends' addresses there; a device has the
    address on its first link that gives it one, else an empty block.  IPv6 blocks stay.
    """
    devices, links = cut(devices), cut(links)  # read by every round of the segments' components and again below
    seg_links, seg_devices = segments(devices, links)
    plan, given = (cut(x) for x in _place(cut(seg_devices), base, prefix))
    nets = seg_links.select("arch_id", "pos", "segment").join(plan.select("arch_id", "segment", "network", F.col("prefix").alias("p"), "mask"), ["arch_id", "segment"])
    ends = links.select("arch_id", "pos", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("device")), F.struct(F.lit("target").alias("side"), F.col("target").alias("device")))).alias("e"))
    ends = cut(ends.select("arch_id", "pos", "e.*").join(nets, ["arch_id", "pos"]).join(given, ["arch_id", "segment", "device"]))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("address"))).alias(s)
    rows = nets.join(ends.groupBy("arch_id", "pos").agg(side("source"), side("target")), ["arch_id", "pos"], "left")
    block = typed_block({"network_address": F.col("network"), "prefix_length": F.col("p"), "subnet_mask": F.col("mask"), "source_ip": F.col("source"), "target_ip": F.col("target")})
    new_links = links.drop("network").join(rows.select("arch_id", "pos", block.alias("network")), ["arch_id", "pos"], "left")
    first = ends.groupBy("arch_id", "device").agg(F.min_by(F.struct("address", "p", "mask", "network"), "pos").alias("b"))
    block = typed_block({"ip_address": F.col("b.address"), "prefix_length": F.col("b.p"), "subnet_mask": F.col("b.mask"), "network_address": F.col("b.network")})
    new_devices = devices.drop("network").join(first.withColumnRenamed("device", "id"), ["arch_id", "id"], "left").withColumn("network", block).drop("b")
    return new_devices.select(devices.columns), new_links.select(links.columns)


def vlsm6(needs: DataFrame, base: str, prefix: int) -> DataFrame:
    """needs (arch_id, segment_no, prefix) -> with ``net`` (limbs), ``network`` (canonical text) and ``fits``: IPv6 blocks, packed like IPv4's.

    A running sum of block sizes, limb by limb; carries are settled afterwards.  A document
    whose blocks exceed the base gets ``fits`` false and NULL networks.
    """
    space = ipaddress.IPv6Network((base, prefix))
    size = ipv6.size(F.col("prefix"))
    order = Window.partitionBy("arch_id").orderBy("prefix", "segment_no").rowsBetween(Window.unboundedPreceding, -1)
    names = ("o", *ipv6.LIMBS)
    before = ipv6.carried(F.struct(*[F.coalesce(F.sum(size[n]).over(order), F.lit(0).cast("bigint")).alias(n) for n in names]))
    whole = ipv6.carried(F.struct(*[F.sum(size[n]).over(Window.partitionBy("arch_id")).alias(n) for n in names]))
    fits = whole <= ipv6.size(F.lit(prefix))
    net = ipv6.narrowed(ipv6.plus(ipv6.widened(ipv6.literal(int(space.network_address))), F.col("_before")))
    rows = needs.withColumn("_before", before).withColumn("fits", fits).withColumn("net", F.when(F.col("fits"), net)).drop("_before")
    return rows.withColumn("network", ipv6.text_of(F.col("net")))


def smallest_prefix6(hosts: Column) -> Column:
    """The longest prefix of /64 to /126 that holds the hosts and the anycast address."""
    tight = F.lit(None).cast("int")
    for p in range(64, 127):
        tight = F.when(hosts <= F.lit(float((1 << (128 - p)) - 1)), F.lit(p)).otherwise(tight)
    return tight


def autoaddress6(devices: DataFrame, links: DataFrame, base: str = "2001:db8::", prefix: int = 48, segment_prefix: int | None = 64) -> tuple[DataFrame, DataFrame]:
    """A fresh IPv6 plan, a /64 for each segment, or with ``segment_prefix`` None the smallest block that fits.

    Returns (arch_id, segment, network, prefix, hosts, fits) and (arch_id, segment, device, address).
    """
    seg_devices = cut(segments(devices, links)[1])
    needs = seg_devices.groupBy("arch_id", "segment", "segment_no").agg(F.count_if("is_host").alias("hosts"))
    needs = needs.withColumn("prefix", F.lit(segment_prefix) if segment_prefix is not None else smallest_prefix6(F.col("hosts")))
    blocks = vlsm6(needs, base, prefix)
    rank = F.row_number().over(Window.partitionBy("arch_id", "segment").orderBy(role_order(F.col("type")), "device_pos"))
    hosts = seg_devices.where("is_host").withColumn("n", rank).join(blocks.select("arch_id", "segment", "net"), ["arch_id", "segment"])
    address = ipv6.text_of(ipv6.narrowed(ipv6.plus(ipv6.widened(F.col("net")), ipv6.of_long(F.col("n").cast("long")))))
    given = hosts.select("arch_id", "segment", "device", F.when(F.col("net").isNotNull(), address).alias("address"))
    return blocks.select("arch_id", "segment", "network", "prefix", "hosts", "fits"), given
