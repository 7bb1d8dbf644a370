"""Cloud plans: hosting choice, runtime names, effective prefixes, limitations and contract differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import duplicate_lan_addresses, switch_cycles

# Reservations in MiB, and limits of the profile.
BASE_MEMORY = 512
MEMORY = {"pc": 128, "server": 256, "router": 256, "switch": 64, "bridge": 64}
MAX_DEVICES, MAX_LINKS, MAX_PRICE = 16, 24, "0.0400"
# Instance type, MiB, virtual CPUs, dollars an hour.
OFFERS = [("t3a.micro", 1024, 2, "0.0094"), ("t3.micro", 1024, 2, "0.0104"), ("t3a.small", 2048, 2, "0.0188"), ("t3.small", 2048, 2, "0.0209"), ("t3a.medium", 4096, 2, "0.0376"), ("t3.medium", 4096, 2, "0.0418")]
# What every plan leaves open.
LIMITATIONS = (
    "Runtime implementation and packet behavior have not been verified.",
    "Routing protocols, gateways and services require the later user configuration stage.",
    "Worker capacity is provisional; catalog prices and availability need rechecking before deployment.",
    "Management access, Linux image and package delivery must be resolved before configuration.",
)
CYCLE = "Switch cycle has no configured loop control; safe forwarding is not established."


def offers(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(OFFERS, "instance_type string, memory_mib int, vcpus int, price string")
    return rows.select("instance_type", "memory_mib", "vcpus", F.col("price").cast("decimal(10,4)").alias("hourly_compute_usd"))


CATALOG = "max_hourly_compute_usd string, offers array<struct<instance_type: string, memory_mib: int, vcpus: int, hourly_compute_usd: string>>"


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    """The offers of a catalog (JSON files) that its own cost cap allows."""
    rows = spark.read.schema(CATALOG).json(path, multiLine=True).select(F.col("max_hourly_compute_usd").cast("decimal(10,4)").alias("most"), F.explode("offers").alias("o"))
    price = F.col("o.hourly_compute_usd").cast("decimal(10,4)")
    return rows.where(price <= F.col("most")).select("o.instance_type", "o.memory_mib", "o.vcpus", price.alias("hourly_compute_usd"))


def runtime_id(kind: str, c: Column) -> Column:
    """A safe name: the kind and 12 hex digits of the id's SHA-256."""
    return F.concat(F.lit(kind), F.substring(F.sha2(c, 256), 1, 12))


def reservations(devices: DataFrame, links: DataFrame) -> DataFrame:
    """(arch_id, devices, links, unsupported: array, required_mib)."""
    role = F.lower("type")
    known = F.create_map(*[F.lit(x) for kv in MEMORY.items() for x in kv])
    per = devices.groupBy("arch_id").agg(
        F.count(F.lit(1)).alias("devices"),
        F.array_sort(F.collect_set(F.when(~role.isin(*MEMORY), role))).alias("unsupported"),
        (F.sum(F.coalesce(F.element_at(known, F.when(role.isin(*MEMORY), role)), F.lit(0))) + BASE_MEMORY).alias("required_mib"),
    )
    n = links.groupBy("arch_id").agg(F.count(F.lit(1)).alias("links"))
    return per.join(n, "arch_id", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))


def select_hosting(devices: DataFrame, links: DataFrame, catalogue: DataFrame, max_devices: int = MAX_DEVICES, max_links: int = MAX_LINKS, max_price: str = MAX_PRICE) -> DataFrame:
    """(arch_id, required_mib, instance_type, hourly_compute_usd, refused): the cheapest offer that fits, ties by name; or why there is none."""
    need = reservations(devices, links)
    fit = need.join(F.broadcast(catalogue), (F.col("memory_mib") >= F.col("required_mib")) & (F.col("hourly_compute_usd") <= F.lit(max_price).cast("decimal(10,4)")), "left")  # a price list
    best = fit.groupBy("arch_id", "devices", "links", "unsupported", "required_mib").agg(F.min(F.when(F.col("instance_type").isNotNull(), F.struct("hourly_compute_usd", "instance_type"))).alias("o"))
    refused = F.when(F.size("unsupported") > 0, "unsupported_type").when((F.col("devices") > max_devices) | (F.col("links") > max_links), "too_large").when(F.col("o").isNull(), "no_offer")
    out = best.withColumn("refused", refused)
    ok = F.col("refused").isNull()
    return out.select("arch_id", "required_mib", F.when(ok, F.col("o.instance_type")).alias("instance_type"), F.when(ok, F.col("o.hourly_compute_usd")).alias("hourly_compute_usd"), "refused")


def device_mapping(devices: DataFrame) -> DataFrame:
    """(arch_id, pos, device_id, kind, runtime_id, filesystem_isolation)."""
    bridge = F.lower("type").isin("switch", "bridge")
    return devices.select("arch_id", "pos", F.col("id").alias("device_id"), F.when(bridge, "linux_bridge").otherwise("network_namespace").alias("kind"), runtime_id("n", F.col("id")).alias("runtime_id"), (~bridge).alias("filesystem_isolation"))


def plan_endpoints(devices: DataFrame, links: DataFrame) -> DataFrame:
    """(arch_id, pos, link_id, side, device_id, runtime_ref, interface_id, ip_address, prefix_length).

    A device's own prefix holds for its own main address; other addresses have the
    link's; none without an address.
    """
    side = F.explode(F.array(F.lit("source"), F.lit("target"))).alias("side")
    ends = links.select("arch_id", "pos", F.col("id").alias("link_id"), "source", "target", "network", side)
    src = F.col("side") == "source"
    net = F.col("network")
    ends = ends.select(
        "arch_id", "pos", "link_id", "side", F.when(src, F.col("source")).otherwise(F.col("target")).alias("device_id"),
        F.when(src, net["source_ip"]).otherwise(net["target_ip"])["text"].alias("ip_address"), net["prefix_length"]["text"].try_cast("int").alias("link_prefix"),
    )
    own = devices.select("arch_id", F.col("id").alias("device_id"), F.col("network")["ip_address"]["text"].alias("main_ip"), F.col("network")["prefix_length"]["text"].try_cast("int").alias("main_prefix"))
    rows = ends.join(own, ["arch_id", "device_id"])
    ip = F.col("ip_address")
    prefix = F.when(ip.isNull(), None).when(ip == F.col("main_ip"), F.col("main_prefix")).otherwise(F.col("link_prefix"))
    interface = F.when(F.col("side") == "source", runtime_id("va", F.col("link_id"))).otherwise(runtime_id("vb", F.col("link_id")))
    return rows.select("arch_id", "pos", "link_id", "side", "device_id", runtime_id("n", F.col("device_id")).alias("runtime_ref"), interface.alias("interface_id"), "ip_address", prefix.alias("prefix_length"))


def configuration_targets(devices: DataFrame, links: DataFrame) -> DataFrame:
    """(arch_id, pos, device_id, runtime_ref, interface_refs in the order of links)."""
    ends = plan_endpoints(devices, links)
    order = F.struct("pos", F.when(F.col("side") == "source", 0).otherwise(1).alias("s"), "interface_id")
    refs = ends.groupBy("arch_id", "device_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["interface_id"]).alias("interface_refs"))
    return device_mapping(devices).join(refs, ["arch_id", "device_id"], "left").select("arch_id", "pos", "device_id", F.col("runtime_id").alias("runtime_ref"), F.coalesce("interface_refs", F.array().cast("array<string>")).alias("interface_refs"))


def limitations(devices: DataFrame, links: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """(arch_id, limitations): the fixed ones, address warnings, switch cycles, and a line for each extension in unknown (arch_id, ord, path)."""
    warn = duplicate_lan_addresses(devices, links)
    message = F.concat(F.lit("Address "), F.col("value"), F.lit(" is also used by device '"), F.col("owner"), F.lit("' on this LAN; preserve only if intentional."))
    lines = warn.groupBy("arch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "side", message.alias("m")))), lambda x: x["m"]).alias("warnings"))
    out = devices.select("arch_id").distinct().join(lines, "arch_id", "left").join(switch_cycles(devices, links), "arch_id", "left")
    none = F.array().cast("array<string>")
    parts = [F.array(*[F.lit(x) for x in LIMITATIONS]), F.coalesce("warnings", none), F.when(F.col("has_cycle"), F.array(F.lit(CYCLE))).otherwise(none)]
    if unknown is not None:
        text = F.concat(F.lit("Uninterpreted source extension "), F.col("path"), F.lit("; retained in architecture, not implemented."))
        extra = unknown.groupBy("arch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("m")))), lambda x: x["m"]).alias("extra"))
        out = out.join(extra, "arch_id", "left")
        parts.append(F.coalesce("extra", none))
    return out.select("arch_id", F.concat(*parts).alias("limitations"))


def differences(actual: DataFrame, required: DataFrame) -> DataFrame:
    """(arch_id, path, kind, text) leaves of two plans -> (arch_id, path, problem), in the order of paths: missing, unexpected, type or value."""
    a = actual.select("arch_id", "path", F.col("kind").alias("a_kind"), F.col("text").alias("a_text"), F.lit(True).alias("a"))
    r = required.select("arch_id", "path", F.col("kind").alias("r_kind"), F.col("text").alias("r_text"), F.lit(True).alias("r"))
    both = a.join(r, ["arch_id", "path"], "full_outer")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("r").isNull(), "unexpected").when(~F.col("a_kind").eqNullSafe(F.col("r_kind")), "type").when(~F.col("a_text").eqNullSafe(F.col("r_text")), "value")
    return both.select("arch_id", "path", problem.alias("problem")).where("problem is not null")
