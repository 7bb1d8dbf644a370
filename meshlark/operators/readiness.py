"""Readiness rules: is a topology document complete enough to be planned?

Documents come as the tables of ``sources.topology``.  Each rule is a filter, an anti-join
or a count; a finding has the code, the JSON pointer and the message.  Devices with all
network fields null are fine if they are switches, bridges or hubs.  IPv6 is not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import addr
from ..functions.text import named, quoted
from ..plans.lineage import cut
from .findings import explode_findings, finding, gather

DEVICES, LINKS, GRAPH = 10, 20, 30
DEVICE_FIELDS = ("ip_address", "prefix_length", "subnet_mask", "network_address")


def _at(group: str, *rest: str) -> Column:
    return F.concat(F.lit(f"/{group}/"), F.col("pos").cast("string"), F.lit("".join("/" + r for r in rest)))


def ip(f: Column) -> Column:
    return F.when(f["kind"] == "STRING", addr.ip_to_int(f["text"]))


def prefix(f: Column) -> Column:
    """A JSON integer from 0 to 32; 24.0, "24" and true are none."""
    value = f["text"].try_cast("int")
    return F.when((f["kind"] == "BIGINT") & value.between(0, 32), value)


def parsed(items: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Adds _<field>: addresses as numbers, the prefix as an integer; parsed once, so that rules stay small expressions.

    All addresses go through one expression: written out for each, the generated method is too large for the JVM to compile.
    """
    net, addresses = F.col("network"), [f for f in fields if f != "prefix_length"]
    rows = items.withColumn("_ips", F.transform(F.array(*[net[f] for f in addresses]), ip))
    return rows.withColumns({f"_{f}": prefix(net[f]) if f == "prefix_length" else F.get("_ips", F.lit(addresses.index(f))) for f in fields}).drop("_ips")


def _mask_rules(p: Column, seq: int, path: Column, active: Column) -> list[Column]:
    text = F.col("network")["subnet_mask"]["kind"] == "STRING"
    value = F.col("_subnet_mask")
    return [
        finding(active & ~text, seq, "invalid_subnet_mask", path, "Provide the subnet mask as a dotted IPv4 string."),
        finding(active & text & value.isNull(), seq, "invalid_subnet_mask", path, "The subnet mask is not a valid IPv4 address."),
        finding(active & value.isNotNull() & p.isNotNull() & (value != addr.mask_of(p)), seq, "subnet_mask_mismatch", path, F.concat(F.lit("subnet_mask does not match prefix_length /"), p.cast("string"), F.lit("."))),
    ]


def _ip_rules(kind: Column, value: Column, seq: int, code: str, path: Column, active: Column) -> list[Column]:
    text = kind == "STRING"
    return [
        finding(active & ~text, seq, code, path, "Provide an IPv4 address string."),
        finding(active & text & value.isNull(), seq, code, path, "The IPv4 address is invalid."),
    ]


def _prefix_rule(seq: int, path: Column, active: Column) -> Column:
    return finding(active & F.col("_prefix_length").isNull(), seq, "invalid_prefix_length", path, "Provide an integer prefix length from 0 to 32.")


def _missing(net: Column, fields: tuple[str, ...], seq: int, base: str, group: str, active: Column) -> list[Column]:
    return [finding(active & net[f]["kind"].isNull(), seq, f"missing_{f}", _at(group, base, f), f"Provide {f}.") for f in fields]


def first_ids(items: DataFrame) -> DataFrame:
    """Adds ``nth``: how many items before, in the document, have the same usable id (0: none)."""
    usable = F.coalesce(F.col("is_object") & named(F.col("id")), F.lit(False))
    same = Window.partitionBy("arch_id", F.when(usable, F.col("id")), F.when(~usable, F.col("pos"))).orderBy("pos")  # an item without an id is alone
    return items.withColumn("nth", F.when(usable, F.row_number().over(same) - 1))


def device_rows(devices: DataFrame) -> DataFrame:
    """What the rules read of devices: their place among equal ids, and parsed fields."""
    return parsed(first_ids(devices.drop("network6")), DEVICE_FIELDS)


def device_findings(d: DataFrame) -> DataFrame:
    """Findings on ``device_rows``."""
    obj, net = F.col("is_object"), F.col("network")
    nulls = [net[f]["kind"].isNull() for f in DEVICE_FIELDS]
    empty, partial = nulls[0] & nulls[1] & nulls[2] & nulls[3], nulls[0] | nulls[1] | nulls[2] | nulls[3]
    checked = obj & net.isNotNull() & ~(addr.is_layer2(F.col("type")) & empty)
    full = checked & ~partial
    i, p, base = F.col("_ip_address"), F.col("_prefix_length"), F.col("_network_address")
    d = d.withColumn("_right", addr.network_of(i, p))
    right = F.col("_right")
    rules = [
        finding(~obj, 0, "invalid_device", _at("devices"), "Each device must be an object."),
        finding(obj & ~named(F.col("id")), 1, "missing_device_id", _at("devices", "id"), "Give this device a nonempty unique ID, such as device_1."),
        finding(F.col("nth") > 0, 1, "duplicate_device_id", _at("devices", "id"), F.concat(F.lit("Device ID "), quoted(F.col("id")), F.lit(" is already used."))),
        finding(obj & ~named(F.col("name")), 2, "missing_device_name", _at("devices", "name"), "Give this device a nonempty display name, such as R1."),
        finding(obj & ~named(F.col("type")), 3, "missing_device_type", _at("devices", "type"), "Specify the device type, such as pc, router, server or switch."),
        finding(obj & net.isNull(), 4, "missing_device_network", _at("devices", "network"), "Provide a network object; use null values for fields that do not apply."),
        *_missing(net, DEVICE_FIELDS, 5, "network", "devices", checked),
        *_ip_rules(net["ip_address"]["kind"], i, 6, "invalid_ip_address", _at("devices", "network", "ip_address"), full),
        _prefix_rule(7, _at("devices", "network", "prefix_length"), full),
        *_mask_rules(p, 8, _at("devices", "network", "subnet_mask"), full),
        *_ip_rules(net["network_address"]["kind"], base, 9, "invalid_network_address", _at("devices", "network", "network_address"), full),
        finding(
            full & (base != right),
            10,
            "network_address_mismatch",
            _at("devices", "network", "network_address"),
            F.concat(F.lit("network_address should be "), addr.int_to_ip(right), F.lit(" for "), addr.int_to_ip(i), F.lit("/"), p.cast("string"), F.lit(".")),
        ),
    ]
    return explode_findings(d, DEVICES, F.col("pos"), rules)


def known_devices(devices: DataFrame) -> DataFrame:
    """Devices that links can refer to, the first of each id: (arch_id, device_id, device_pos, role, main_ip)."""
    return _known(parsed(first_ids(devices), ("ip_address", "prefix_length")))


def _known(rows: DataFrame) -> DataFrame:
    net = F.col("network")
    full = F.lit(True)
    for f in DEVICE_FIELDS:
        full = full & net[f]["kind"].isNotNull()
    first = rows.where("nth = 0")
    main = F.when(full & F.col("_prefix_length").isNotNull(), F.col("_ip_address"))
    return first.select("arch_id", F.col("id").alias("device_id"), F.col("pos").alias("device_pos"), F.lower(F.coalesce("type", F.lit(""))).alias("role"), main.alias("main_ip"))


def endpoints(links: DataFrame, devices: DataFrame) -> DataFrame:
    """Both ends of each link, with the device they refer to: one equi-join for all link rules."""
    return _ends(first_ids(links), known_devices(devices))


def _ends(links: DataFrame, known: DataFrame) -> DataFrame:
    ends = links.where("is_object").withColumn("side", F.explode(F.array(F.lit("source"), F.lit("target"))))
    mine = lambda a, b: F.when(F.col("side") == "source", a).otherwise(b)
    ends = ends.withColumn("device_id", mine(F.col("source"), F.col("target"))).withColumn("end_ip", mine(F.col("network")["source_ip"], F.col("network")["target_ip"]))
    return ends.join(known, ["arch_id", "device_id"], "left").withColumn("_end", ip(F.col("end_ip")))


def _link_rows(rows: DataFrame) -> DataFrame:
    """Adds the parsed network: _full if no field is missing, _net_base and _net_prefix if it is valid."""
    net = F.col("network")
    full = net["network_address"]["kind"].isNotNull() & net["prefix_length"]["kind"].isNotNull() & net["subnet_mask"]["kind"].isNotNull()
    rows = parsed(rows, ("network_address", "prefix_length", "subnet_mask")).withColumn("_full", F.col("is_object") & net.isNotNull() & full)
    good = F.col("_full") & (addr.network_of(F.col("_network_address"), F.col("_prefix_length")) == F.col("_network_address"))
    return rows.withColumn("_good", good).withColumns({"_net_base": F.when(F.col("_good"), F.col("_network_address")), "_net_prefix": F.when(F.col("_good"), F.col("_prefix_length"))})


def link_rows(links: DataFrame) -> DataFrame:
    """What the rules read of links: their place among equal ids, and the parsed network."""
    return _link_rows(first_ids(links.drop("network6")))


def link_findings(links: DataFrame, ends: DataFrame) -> DataFrame:
    """Findings on ``link_rows`` and their ends."""
    obj, net = F.col("is_object"), F.col("network")
    checked = obj & net.isNotNull()
    base, full = F.col("_net_base"), F.col("_full")
    own = net["network_address"]
    rules = [
        finding(~obj, 0, "invalid_link", _at("links"), "Each link must be an object."),
        finding(obj & ~named(F.col("id")), 1, "missing_link_id", _at("links", "id"), "Give this link a nonempty ID."),
        finding(F.col("nth") > 0, 1, "duplicate_link_id", _at("links", "id"), F.concat(F.lit("Link ID "), quoted(F.col("id")), F.lit(" is already used."))),
        finding(obj & net.isNull(), 5, "missing_link_network", _at("links", "network"), "Provide this link's network object."),
        *_missing(net, ("network_address", "prefix_length", "subnet_mask"), 6, "network", "links", checked),
        _prefix_rule(7, _at("links", "network", "prefix_length"), full),
        *_mask_rules(F.col("_prefix_length"), 8, _at("links", "network", "subnet_mask"), full),
        finding(full & (own["kind"] != "STRING"), 9, "invalid_network_address", _at("links", "network", "network_address"), "Provide an IPv4 network address string."),
        finding(
            full & (own["kind"] == "STRING") & F.col("_prefix_length").isNotNull() & base.isNull(),
            9,
            "invalid_network_address",
            _at("links", "network", "network_address"),
            "network_address must be the canonical network base for this prefix (no host bits set).",
        ),
    ]
    alone = explode_findings(links, LINKS, F.col("pos"), rules)
    known = F.col("device_pos").isNotNull()
    side, end = F.col("side"), F.col("end_ip")
    at_side = F.concat(_at("links"), F.lit("/"), side)
    at_ip = F.concat(_at("links"), F.lit("/network/"), side, F.lit("_ip"))
    value, p = F.col("_end"), F.col("_net_prefix")
    who = quoted(F.col("device_id"))
    given = known & checked & end["kind"].isNotNull()
    rules = [
        finding(~known, 2, "unknown_device", at_side, F.concat(F.lit("This link's "), side, F.lit(" must reference an existing device ID."))),
        finding((side == "target") & known & (F.col("source") == F.col("target")), 4, "self_link", _at("links"), "Connect this link to another device, not itself."),
        finding(known & checked & end["kind"].isNull() & ~F.col("role").isin(*addr.LAYER2), 10, "missing_link_ip", at_ip, F.concat(F.lit("Provide the address "), who, F.lit(" uses on this link."))),
        *_ip_rules(end["kind"], value, 11, "invalid_link_ip", at_ip, given),
        finding(given & ~addr.ip_in_network(value, base, p), 12, "link_ip_outside_network", at_ip, F.concat(who, F.lit("'s address on this link is not inside the link's network."))),
    ]
    two = explode_findings(ends, LINKS, F.col("pos"), rules)
    return alone.unionByName(two)


def valid_ends(ends: DataFrame) -> DataFrame:
    """Ends of structurally valid links: a usable new id and two different known devices."""
    both = Window.partitionBy("arch_id", "pos")
    return ends.withColumn("_known", F.count("device_pos").over(both)).where("nth = 0 and _known = 2 and source <> target").drop("_known")


def graph_findings(known: DataFrame, ends: DataFrame) -> DataFrame:
    links = valid_ends(ends).groupBy("arch_id", "device_id").agg(F.count(F.lit(1)).alias("n_links"))
    # addresses count even on links that are otherwise invalid
    used = ends.where(F.col("device_pos").isNotNull() & F.col("network").isNotNull()).select("arch_id", "device_id", F.col("_end").alias("ip")).where("ip is not null")
    used = used.join(known.select("arch_id", "device_id", "main_ip"), ["arch_id", "device_id"]).groupBy("arch_id", "device_id").agg(F.max(F.col("ip") == F.col("main_ip")).alias("main_used"))
    all_of = known.join(links, ["arch_id", "device_id"], "left").join(used, ["arch_id", "device_id"], "left")
    path = F.concat(F.lit("/devices/"), F.col("device_pos").cast("string"))
    who = quoted(F.col("device_id"))
    rules = [
        finding(F.col("n_links").isNull(), 0, "isolated_device", path, F.concat(F.lit("Device "), who, F.lit(" has no valid link to another device."))),
        finding((F.col("n_links") > 1) & (F.col("role") == "pc"), 0, "too_many_links", path, F.concat(F.lit("Device "), who, F.lit(" is a pc; a pc may have only one link."))),
        finding(F.col("main_ip").isNotNull() & (~F.col("main_used")), 1, "device_ip_not_on_link", F.concat(path, F.lit("/network/ip_address")), F.concat(F.lit("Device "), who, F.lit("'s ip_address is not the address it uses on any link."))),
    ]
    return explode_findings(all_of, GRAPH, F.col("device_pos"), rules)


def document_findings(headers: DataFrame) -> DataFrame:
    """Documents that are no object, or lack a nonempty list."""
    ok = F.col("kind") == "OBJECT"
    bad = F.col("kind").isNull() | ~ok
    rules = [
        finding(bad, 0, "invalid_architecture", F.lit(""), "The architecture must be a JSON object."),
        finding(ok & ~F.col("finite"), 0, "invalid_json_value", F.lit(""), "Use JSON values with finite numbers only."),
        finding(ok & F.col("finite") & (F.coalesce("devices", F.lit(0)) == 0), 1, "missing_devices", F.lit("/devices"), "Provide a nonempty list of devices."),
        finding(ok & F.col("finite") & (F.coalesce("links", F.lit(0)) == 0), 2, "missing_links", F.lit("/links"), "Provide links connecting the devices."),
    ]
    return explode_findings(headers, 0, F.lit(0), rules)


def check(devices: DataFrame, links: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """All readiness findings of all documents; a document without any is ready."""
    # each is read by several rules; what they read is parsed before, so that the JVM compiles the rules
    devices, links = cut(device_rows(devices)), cut(link_rows(links))
    known = _known(devices)
    ends = cut(_ends(links, known))
    parts = [device_findings(devices), link_findings(links, ends), graph_findings(known, ends)]
    if headers is not None:
        parts.insert(0, document_findings(headers))
    return gather(*parts)
