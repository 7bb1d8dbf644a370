"""The stricter rule set: both address families, host addresses, duplicates, segments and overlaps.

Its errors include those of readiness; unlike it, it goes on checking the fields
that are present, and wants names and addresses to be unique within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addr, ipv6
from ..functions.text import named, quoted
from ..plans.lineage import cut
from . import graph
from .findings import explode_findings, finding, gather
from .readiness import document_findings, first_ids

BLOCK = {4: "network", 6: "network6"}
NAME = {4: "IPv4", 6: "IPv6"}
MOST = {4: 32, 6: 128}
DEVICE = {4: ("ip_address", "prefix_length", "subnet_mask", "network_address"), 6: ("ip_address", "prefix_length", "network_address")}
LINK = {4: ("network_address", "prefix_length", "subnet_mask"), 6: ("network_address", "prefix_length")}
DEVICES, LINKS, GRAPH, SEGMENTS = 10, 20, 30, 50


def _at(group: str, *rest) -> Column:
    steps = [F.lit("/" + r) if isinstance(r, str) else F.concat(F.lit("/"), r) for r in rest]
    return F.concat(F.lit(f"/{group}/"), F.col("pos").cast("string"), *steps)


def _address(fam: int, f: Column, prefix: Column) -> Column:
    """struct(canonical, base, code, severity, version) of an address field of a family; canonical NULL if it is none."""
    text = F.when(f["kind"] == "STRING", f["text"])
    # bound, as a field that is read from an expression evaluates it anew
    if fam == 6:
        version = F.when(addr.is_ipv4(text), 4)
        return addr.bind(
            ipv6.device_facts(text, prefix),
            lambda k: F.struct(*[k[n].alias(n) for n in ("canonical", "base", "code", "severity")], F.when(k["canonical"].isNotNull(), 6).otherwise(version).alias("version")),
        )
    known = F.struct(text.alias("text"), addr.ip_to_int(text).alias("v"), prefix.alias("p"))
    known = addr.bind(known, lambda k: F.struct(k["text"].alias("text"), k["v"].alias("v"), k["p"].alias("p"), addr.host_problem(k["v"], k["p"]).alias("bad")))
    return addr.bind(
        known,
        lambda k: F.struct(
            F.when(k["v"].isNotNull(), k["text"]).alias("canonical"),
            addr.int_to_ip(addr.network_of(k["v"], k["p"])).alias("base"),
            k["bad"]["code"].alias("code"),
            k["bad"]["severity"].alias("severity"),
            F.when(k["v"].isNotNull(), 4).otherwise(addr.ip_version(k["text"])).alias("version"),
        ),
    )


def _prefix(fam: int, f: Column) -> Column:
    value = f["text"].try_cast("int")
    return F.when((f["kind"] == "BIGINT") & value.between(0, MOST[fam]), value)


def _host_message(ip: Column, code: Column, base: Column, prefix: Column, fam: int) -> Column:
    net = F.concat(base, F.lit("/"), prefix.cast("string"))
    zero = F.lit("is the network address of ") if fam == 4 else F.lit("is the subnet-router anycast address of ")
    return (
        F.when(code == "ip_looks_like_mask", F.concat(ip, F.lit(" is a subnet mask, not a device address; the mask was probably read as the IP.")))
        .when(code == "reserved_ip", F.concat(ip, F.lit(" is reserved, loopback, multicast or unspecified, not usable by a device.")))
        .when(code == "ip_is_network_address", F.concat(ip, F.lit(" "), zero, net, F.lit(", not a host.")))
        .when(code == "ip_is_broadcast_address", F.concat(ip, F.lit(" is the broadcast address of "), net, F.lit(", not a host.")))
        .otherwise(F.concat(ip, F.lit(" is link-local; it is only valid on its own link.")))
    )


def _ip_rules(fam: int, f: Column, a: Column, seq: int, code: str, path: Column, on: Column, subject: Column) -> list[Column]:
    """Not an address of the family; or one that is not written in its canonical form."""
    other = 10 - fam
    shown = F.when(f["kind"] == "STRING", quoted(f["text"])).otherwise(f["text"])
    wrong = F.when(
        a["version"] == other, F.concat(shown, F.lit(f" is an {NAME[other]} address; this field is {NAME[fam]} ({BLOCK[other]} holds {NAME[other]}).")),
    ).otherwise(F.concat(shown, F.lit(f" is not a valid {NAME[fam]} address.")))
    given = on & f["kind"].isNotNull()
    return [
        finding(given & a["canonical"].isNull(), seq, code, path, wrong, subject, f["text"]),
        finding(given & (a["canonical"] != f["text"]), seq, "non_canonical_ip", path, F.concat(F.lit("Write "), shown, F.lit(" as "), a["canonical"], F.lit(".")), subject, f["text"], hint={"expected": a["canonical"]}, severity="warning"),
    ]


def _prefix_rule(fam: int, f: Column, p: Column, seq: int, path: Column, on: Column, subject: Column) -> Column:
    return finding(on & f["kind"].isNotNull() & p.isNull(), seq, "invalid_prefix_length", path, f"Provide an integer prefix length from 0 to {MOST[fam]} ({NAME[fam]}).", subject, f["text"])


def _mask_rules(fam: int, f: Column, p: Column, seq: int, path: Column, on: Column, subject: Column) -> list[Column]:
    given = on & f["kind"].isNotNull()
    if fam == 6:
        return [finding(given, seq, "unexpected_subnet_mask", path, "IPv6 has no subnet mask; use prefix_length.", subject, f["text"])]
    text = F.when(f["kind"] == "STRING", f["text"])
    shown = F.when(f["kind"] == "STRING", quoted(f["text"])).otherwise(f["text"])
    parsed, as_prefix = F.col("_mask_ip"), F.col("_mask_prefix")
    said = F.when(as_prefix.isNull(), F.lit("")).otherwise(F.concat(F.lit(" is /"), as_prefix.cast("string"), F.lit(" but prefix_length")))
    right = addr.prefix_to_mask(p)
    slash = F.concat(F.lit("/"), p.cast("string"))
    return [
        finding(given & parsed.isNull(), seq, "invalid_subnet_mask", path, F.concat(shown, F.lit(" is not a dotted IPv4 subnet mask.")), subject, f["text"]),
        finding(given & parsed.isNotNull() & as_prefix.isNull(), seq, "invalid_subnet_mask", path, F.concat(text, F.lit(" is not a subnet mask: its 1-bits must be contiguous (like 255.255.255.0).")), subject, f["text"]),
        finding(
            given & parsed.isNotNull() & p.isNotNull() & ~as_prefix.eqNullSafe(p), seq, "subnet_mask_mismatch", path,
            F.concat(F.lit("subnet_mask "), text, said, F.lit(" does not match prefix_length "), slash, F.lit(" ("), slash, F.lit(" is "), right, F.lit(").")), subject, f["text"], hint={"expected": right},
        ),
    ]


def _host_rule(a: Column, p: Column, fam: int, seq: int, path: Column, on: Column, subject: Column) -> Column:
    return finding(on & a["code"].isNotNull(), seq, a["code"], path, _host_message(a["canonical"], a["code"], a["base"], p, fam), subject, a["canonical"], severity=a["severity"])


def _with_block(items: DataFrame, fam: int, addresses: dict[str, str]) -> DataFrame:
    """Rows that have the family's block, as ``net``; with ``_p``, mask columns, and one struct for each address field."""
    rows = items.where(F.col(BLOCK[fam]).isNotNull()).withColumn("net", F.col(BLOCK[fam]))
    rows = rows.withColumn("_p", _prefix(fam, F.col("net")["prefix_length"]))
    mask = F.when(F.col("net")["subnet_mask"]["kind"] == "STRING", F.col("net")["subnet_mask"]["text"])
    rows = rows.withColumn("_mask_ip", addr.ip_to_int(mask)).withColumn("_mask_prefix", addr.mask_to_prefix(mask, zero_ok=True))
    return rows.withColumns({name: _address(fam, F.col("net")[f], F.col("_p")) for f, name in addresses.items()})


def device_blocks(devices: DataFrame, fam: int, require_ipv4: bool = True) -> DataFrame:
    """Device rows with their family's parsed block and ``_on``: whether it is checked."""
    rows = _with_block(first_ids(devices), fam, {"ip_address": "_ip", "network_address": "_base"})
    blank = F.lit(True)
    for f in DEVICE[fam]:
        blank = blank & F.col("net")[f]["kind"].isNull()
    optional = addr.is_layer2(F.col("type")) | F.lit(fam == 4 and not require_ipv4)
    return rows.withColumn("_on", ~(optional & blank))


def _device_rules(rows: DataFrame, fam: int) -> DataFrame:
    net, p, ip, base, on = F.col("net"), F.col("_p"), F.col("_ip"), F.col("_base"), F.col("_on")
    who = F.when(named(F.col("id")), F.col("id"))
    at = lambda f: _at("devices", BLOCK[fam], f)
    pair = F.concat(ip["canonical"], F.lit("/"), p.cast("string"))
    rules = [
        *[finding(on & net[f]["kind"].isNull(), 10 * fam, f"missing_{f}", at(f), f"Provide {f} ({NAME[fam]}).", who) for f in DEVICE[fam]],
        _prefix_rule(fam, net["prefix_length"], p, 10 * fam + 1, at("prefix_length"), on, who),
        *_mask_rules(fam, net["subnet_mask"], p, 10 * fam + 2, at("subnet_mask"), on, who),
        *_ip_rules(fam, net["ip_address"], ip, 10 * fam + 3, "invalid_ip_address", at("ip_address"), on, who),
        *_ip_rules(fam, net["network_address"], base, 10 * fam + 4, "invalid_network_address", at("network_address"), on, who),
        finding(
            on & (base["canonical"] != ip["base"]), 10 * fam + 5, "network_address_mismatch", at("network_address"),
            F.concat(F.lit("network_address should be "), ip["base"], F.lit(" for "), pair, F.lit(".")), who, net["network_address"]["text"], hint={"expected": ip["base"]},
        ),
        _host_rule(ip, p, fam, 10 * fam + 6, at("ip_address"), on, who),
    ]
    return explode_findings(rows, DEVICES, F.col("pos"), rules)


def _complete(fam: int) -> Column:
    out = F.col(BLOCK[fam]).isNotNull()
    for f in DEVICE[fam]:
        out = out & F.col(BLOCK[fam])[f]["kind"].isNotNull()
    return F.coalesce(out, F.lit(False))


def _device_shape(devices: DataFrame, require_ipv4: bool) -> DataFrame:
    obj = F.col("is_object")
    who = F.when(named(F.col("id")), F.col("id"))
    rules = [
        finding(~obj, 0, "invalid_device", _at("devices"), "Each device must be an object."),
        finding(obj & ~named(F.col("id")), 1, "missing_device_id", _at("devices", "id"), "Give this device a nonempty unique ID, such as device_1."),
        finding(F.col("nth") > 0, 1, "duplicate_device_id", _at("devices", "id"), F.concat(F.lit("Device ID "), quoted(F.col("id")), F.lit(" is already used.")), who),
        finding(obj & ~named(F.col("name")), 2, "missing_device_name", _at("devices", "name"), "Give this device a nonempty display name, such as R1.", who),
        finding(obj & ~named(F.col("type")), 3, "missing_device_type", _at("devices", "type"), "Specify the device type, such as pc, router, server or switch.", who),
        finding(obj & F.col("network").isNull(), 4, "missing_device_network", _at("devices", "network"), "Provide a network object; use null values for fields that do not apply.", who),
    ]
    if not require_ipv4:
        rules.append(finding(obj & ~addr.is_layer2(F.col("type")) & ~_complete(4) & ~_complete(6), 99, "missing_device_address", _at("devices"), "Give this device an IPv4 or an IPv6 address.", who))
    return explode_findings(first_ids(devices), DEVICES, F.col("pos"), rules)


def duplicate_names(known: DataFrame) -> DataFrame:
    """Names that several devices share, whatever their case: a finding for each."""
    trimmed = known.where(named(F.col("name"))).withColumn("_key", F.lower(F.regexp_replace("name", r"(?U)^\s+|\s+$", "")))
    ids = trimmed.groupBy("arch_id", "_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids")).where(F.size("ids") > 1)
    rows = trimmed.join(ids, ["arch_id", "_key"])
    message = F.concat(F.lit("The name "), quoted(F.col("name")), F.lit(" is used by "), F.size("ids").cast("string"), F.lit(" devices; each device needs its own name."))
    rule = finding(F.lit(True), 0, "duplicate_device_name", _at("devices", "name"), message, F.col("id"), F.col("name"), F.filter("ids", lambda x: x != F.col("id")))
    return explode_findings(rows, DEVICES + 5, F.col("pos"), [rule])


def _known(devices: DataFrame) -> DataFrame:
    return first_ids(devices).where("nth = 0")


def link_ends(links: DataFrame, known: DataFrame, fam: int, require_ipv4: bool) -> DataFrame:
    """Ends of links that have the family's block, with the parsed network (``_lo``, ``_hi``, ``_net``: NULL if invalid) and end address."""
    rows = _with_block(first_ids(links).where("is_object"), fam, {"network_address": "_base"})
    if fam == 4 and not require_ipv4:
        none = F.lit(True)
        for f in ("network_address", "prefix_length", "subnet_mask", "source_ip", "target_ip"):
            none = none & F.col("net")[f]["kind"].isNull()
        rows = rows.where(~(none & F.col("network6").isNotNull()))
    if fam == 4:
        good = addr.ip_to_int(F.col("_base")["canonical"])
        rows = rows.withColumn("_int", good).withColumn("_lo_int", F.when(addr.network_of(F.col("_int"), F.col("_p")) == F.col("_int"), F.col("_int")))
        text = lambda v: F.lower(F.lpad(F.hex(v), 32, "0"))
        rows = rows.withColumns({"_lo": text(F.col("_lo_int")), "_hi": text(addr.broadcast_of(F.col("_lo_int"), F.col("_p")))})
        rows = rows.withColumn("_net", F.when(F.col("_lo").isNotNull(), F.concat(F.col("_base")["canonical"], F.lit("/"), F.col("_p").cast("string")))).drop("_int", "_lo_int")
    else:
        rows = rows.withColumn("_r", ipv6.network_range(F.col("_base")["canonical"], F.col("_p"))).withColumns({"_lo": F.col("_r")["lo"], "_hi": F.col("_r")["hi"], "_net": F.col("_r")["text"]}).drop("_r")
    rows = rows.withColumn("side", F.explode(F.array(F.lit("source"), F.lit("target"))))
    src = F.col("side") == "source"
    rows = rows.withColumn("device_id", F.when(src, F.col("source")).otherwise(F.col("target"))).withColumn("end", F.when(src, F.col("net")["source_ip"]).otherwise(F.col("net")["target_ip"]))
    rows = rows.withColumn("_end", _address(fam, F.col("end"), F.col("_p"))).withColumn("_end_hex", _hex_of(fam, F.col("_end")["canonical"]))
    mine = known.select("arch_id", F.col("id").alias("device_id"), F.col("pos").alias("device_pos"), F.col("type").alias("role"))
    return rows.join(mine, ["arch_id", "device_id"], "left")


def _hex_of(fam: int, canonical: Column) -> Column:
    if fam == 4:
        return F.lower(F.lpad(F.hex(addr.ip_to_int(canonical)), 32, "0"))
    return ipv6.hex32(ipv6.parse(canonical))


def _link_rules(ends: DataFrame, fam: int) -> DataFrame:
    net, p, base = F.col("net"), F.col("_p"), F.col("_base")
    who = F.when(F.col("nth") == 0, F.col("id"))
    at = lambda f: _at("links", BLOCK[fam], f)
    once, on = F.col("side") == "source", F.lit(True)
    known = F.col("device_pos").isNotNull()
    end, ip = F.col("end"), F.col("_end")
    at_ip = _at("links", BLOCK[fam], F.concat(F.col("side"), F.lit("_ip")))
    right = base["base"]
    host_bits = F.concat(base["canonical"], F.lit(" has host bits set for /"), p.cast("string"), F.lit("; the network is "), right, F.lit("."))
    related = F.array("device_id")
    inside = F.col("_end_hex").between(F.col("_lo"), F.col("_hi"))
    rules = [
        *[finding(once & net[f]["kind"].isNull(), 10 * fam, f"missing_{f}", at(f), f"Provide {f} ({NAME[fam]}).", who) for f in LINK[fam]],
        _prefix_rule(fam, net["prefix_length"], p, 10 * fam + 1, at("prefix_length"), once, who),
        *_mask_rules(fam, net["subnet_mask"], p, 10 * fam + 2, at("subnet_mask"), once, who),
        *_ip_rules(fam, net["network_address"], base, 10 * fam + 3, "invalid_network_address", at("network_address"), once, who),
        finding(once & base["canonical"].isNotNull() & p.isNotNull() & F.col("_net").isNull(), 10 * fam + 4, "invalid_network_address", at("network_address"), host_bits, who, net["network_address"]["text"], hint={"expected": right}),
        finding(known & end["kind"].isNull() & ~addr.is_layer2(F.col("role")), 10 * fam + 5, "missing_link_ip", at_ip, F.concat(F.lit(f"Provide the {NAME[fam]} address "), quoted(F.col("device_id")), F.lit(" uses on this link.")), who, related=related),
        *_ip_rules(fam, end, ip, 10 * fam + 6, "invalid_link_ip", at_ip, known & on, who),
        finding(
            known & ip["canonical"].isNotNull() & ~inside, 10 * fam + 7, "link_ip_outside_network", at_ip,
            F.concat(F.col("device_id"), F.lit("'s address "), ip["canonical"], F.lit(" on this link is not inside the link's network "), F.col("_net"), F.lit(".")), who, end["text"], related,
        ),
        _host_rule(ip, p, fam, 10 * fam + 8, at_ip, known, who),
    ]
    return explode_findings(ends, LINKS, F.col("pos"), rules)


def _link_shape(links: DataFrame, known: DataFrame) -> DataFrame:
    obj, net = F.col("is_object"), F.col("network")
    who = F.when(F.col("nth") == 0, F.col("id"))
    rows = first_ids(links)
    ids = known.select("arch_id", F.col("id").alias("_known"), F.lit(True).alias("_is"))
    for side in ("source", "target"):
        rows = rows.join(ids.withColumnRenamed("_known", side).withColumnRenamed("_is", f"_{side}"), ["arch_id", side], "left")
    message = lambda s: f"This link's {s} must reference an existing device ID."
    rules = [
        finding(~obj, 0, "invalid_link", _at("links"), "Each link must be an object."),
        finding(obj & ~named(F.col("id")), 1, "missing_link_id", _at("links", "id"), "Give this link a nonempty ID."),
        finding(F.col("nth") > 0, 1, "duplicate_link_id", _at("links", "id"), F.concat(F.lit("Link ID "), quoted(F.col("id")), F.lit(" is already used.")), F.col("id")),
        *[finding(obj & F.col(f"_{s}").isNull(), 2, "unknown_device", _at("links", s), message(s), who, F.col(s)) for s in ("source", "target")],
        finding(obj & F.col("_source").isNotNull() & (F.col("source") == F.col("target")), 3, "self_link", _at("links"), "Connect this link to another device, not itself.", who),
        finding(obj & net.isNull(), 4, "missing_link_network", _at("links", "network"), "Provide this link's network object.", who),
    ]
    return explode_findings(rows, LINKS, F.col("pos"), rules)


def valid_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links with a usable new id between two different known devices."""
    rows = first_ids(links).where("nth = 0 and source <> target")
    ids = known.select("arch_id", "id")
    for side in ("source", "target"):
        rows = rows.join(ids.withColumnRenamed("id", side), ["arch_id", side], "left_semi")
    return rows


def _connectivity(known: DataFrame, good: DataFrame, own: DataFrame, used: DataFrame) -> DataFrame:
    """own (arch_id, id, fam, ip), used (arch_id, id, fam, ips)."""
    ends = good.select("arch_id", F.explode(F.array("source", "target")).alias("id"))
    n = ends.groupBy("arch_id", "id").agg(F.count(F.lit(1)).alias("n"))
    rows = known.join(n, ["arch_id", "id"], "left")
    who = quoted(F.col("id"))
    alone = explode_findings(rows, GRAPH, F.col("pos"), [
        finding(F.col("n").isNull(), 0, "isolated_device", _at("devices"), F.concat(F.lit("Device "), who, F.lit(" has no valid link to another device.")), F.col("id")),
        finding((F.col("n") > 1) & (F.lower("type") == "pc"), 0, "too_many_links", _at("devices"), F.concat(F.lit("Device "), who, F.lit(" is a pc; a pc may have only one link.")), F.col("id")),
    ])
    both = own.join(used, ["arch_id", "id", "fam"]).where(~F.array_contains("ips", F.col("ip"))).join(known.select("arch_id", "id", "pos"), ["arch_id", "id"])
    block = F.when(F.col("fam") == 4, BLOCK[4]).otherwise(BLOCK[6])
    family = F.when(F.col("fam") == 4, NAME[4]).otherwise(NAME[6])
    message = F.concat(F.lit("Device "), F.col("id"), F.lit("'s "), family, F.lit(" address "), F.col("ip"), F.lit(" is not the address it uses on any link."))
    rule = finding(F.lit(True), 1, "device_ip_not_on_link", _at("devices", block, "ip_address"), message, F.col("id"), F.col("ip"), hint={"link_addresses": F.array_join("ips", ", ")})
    return alone.unionByName(explode_findings(both, GRAPH, F.col("pos"), [rule]))


def duplicate_addresses(uses: DataFrame) -> DataFrame:
    """uses (arch_id, fam, ip, id, pos, path): every use of an address that two devices or more have."""
    owners = uses.groupBy("arch_id", "fam", "ip").agg(F.array_sort(F.collect_set("id")).alias("owners")).where(F.size("owners") > 1)
    rows = uses.join(owners, ["arch_id", "fam", "ip"])
    message = F.concat(F.col("ip"), F.lit(" is used by "), F.size("owners").cast("string"), F.lit(" devices ("), F.array_join("owners", ", "), F.lit("); each device needs its own address."))
    rule = finding(F.lit(True), 0, "duplicate_ip", F.col("path"), message, F.col("id"), F.col("ip"), F.filter("owners", lambda o: o != F.col("id")))
    return explode_findings(rows, GRAPH + 5, F.col("pos"), [rule])


def _leading(lo: Column, bits: Column, fam: int) -> Column:
    """The first ``bits`` bits of an address of 32 hex digits, as text that is equal just where they are."""
    n = bits + (96 if fam == 4 else 0)
    nibble = F.coalesce(F.conv(F.substring(lo, F.floor(n / 4).cast("int") + 1, F.lit(1)), 16, 10).try_cast("int"), F.lit(0))
    part = F.when(n % 4 == 0, 0).otherwise(F.call_function("shiftright", nibble, (4 - n % 4).cast("int")))
    return F.concat(F.substring(lo, F.lit(1), F.floor(n / 4).cast("int")), F.lit("/"), part.cast("string"))


def _segment_rules(seg_links: DataFrame, seg_devices: DataFrame, nets: DataFrame, fam: int, uses: DataFrame, known: DataFrame) -> DataFrame:
    """nets (arch_id, pos, net, lo, hi, p): valid networks of valid links."""
    ids = seg_links.groupBy("arch_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link_id"))), lambda x: x["link_id"]).alias("link_ids"), F.min("pos").alias("first_pos"), F.min_by("link_id", "pos").alias("first_id"))
    bridges = seg_devices.groupBy("arch_id", "segment").agg(F.count_if("is_host").alias("hosts"), F.transform(F.array_sort(F.collect_list(F.when(F.col("is_bridge"), F.struct("first_link", "device")))), lambda x: x["device"]).alias("bridges"))
    rows = seg_links.select("arch_id", "segment", "link_id", "pos").join(nets, ["arch_id", "pos"])
    agg = rows.groupBy("arch_id", "segment").agg(F.array_sort(F.collect_set("net")).alias("all_nets"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("p").alias("p"), F.min_by("link_id", "pos").alias("net_link"), F.min("pos").alias("net_pos"))
    agg = agg.join(ids, ["arch_id", "segment"]).join(bridges, ["arch_id", "segment"])
    mixed = rows.join(agg.where(F.size("all_nets") > 1).select("arch_id", "segment", "all_nets", "link_ids", "bridges"), ["arch_id", "segment"])
    text = F.concat(F.lit("Links "), F.array_join("link_ids", ", "), F.lit(" are one broadcast segment (joined by "), F.array_join("bridges", ", "), F.lit(f") but carry different {NAME[fam]} networks: "), F.array_join("all_nets", ", "), F.lit("."))
    parts = [explode_findings(mixed, SEGMENTS, F.col("pos"), [finding(F.lit(True), fam, "segment_network_mismatch", _at("links", BLOCK[fam], "network_address"), text, F.col("link_id"), F.col("net"), F.filter("link_ids", lambda x: x != F.col("link_id")))])]
    one = agg.where(F.size("all_nets") == 1).withColumn("net", F.col("all_nets")[0])
    room, need = addr.usable_hosts(F.col("p"), fam), addr.smallest_prefix(F.col("hosts"), fam)
    small = one.withColumn("room", room).withColumn("need", need).where("room < hosts").withColumn("pos", F.col("first_pos"))
    text = F.concat(F.col("net"), F.lit(" gives "), F.col("room").cast("bigint").cast("string"), F.lit(" usable address(es) but segment "), F.col("segment"), F.lit(" has "), F.col("hosts").cast("string"), F.lit(" devices; use /"), F.col("need").cast("string"), F.lit(" or shorter."))
    parts.append(explode_findings(small, SEGMENTS, F.col("pos"), [finding(F.lit(True), fam + 1, "network_too_small", _at("links", BLOCK[fam], "prefix_length"), text, F.col("first_id"), F.col("p"), F.col("link_ids"), hint={"hosts": F.col("hosts"), "suggested_prefix": F.col("need")})]))
    # overlaps: networks are aligned blocks, so one of two lies in the other, that is: has it among its own prefixes
    blocks = one.select("arch_id", "segment", "lo", "p")
    within = blocks.select("arch_id", "segment", F.explode(F.sequence(F.lit(0), "p")).alias("q"), "lo").select("arch_id", "segment", "q", _leading(F.col("lo"), F.col("q"), fam).alias("block"))
    whole = blocks.select("arch_id", F.col("segment").alias("other"), F.col("p").alias("q"), _leading(F.col("lo"), F.col("p"), fam).alias("block"))
    pairs = within.join(whole, ["arch_id", "q", "block"]).where("segment <> other").select("arch_id", "segment", "other")
    pairs = pairs.unionByName(pairs.select("arch_id", F.col("other").alias("segment"), F.col("segment").alias("other"))).distinct()
    a = one.select("arch_id", "segment", "net", F.col("net_link"), F.col("net_pos").alias("pos"))
    b = one.select("arch_id", F.col("segment").alias("other"), F.col("net").alias("other_net"), F.col("link_ids").alias("other_links"))
    both = pairs.join(a, ["arch_id", "segment"]).join(b, ["arch_id", "other"])
    pair = F.concat(F.least("segment", "other"), F.lit(" and "), F.greatest("segment", "other"))
    same = F.concat(F.col("net"), F.lit(" is used by two separate segments ("), pair, F.lit("); devices on different segments need different networks."))
    over = F.concat(F.col("net"), F.lit(" ("), F.col("segment"), F.lit(") overlaps "), F.col("other_net"), F.lit(" ("), F.col("other"), F.lit("); VLSM blocks must not overlap."))
    text = F.when(F.col("net") == F.col("other_net"), same).otherwise(over)
    parts.append(explode_findings(both, SEGMENTS + 2, F.col("pos"), [finding(F.lit(True), fam, "overlapping_networks", _at("links", BLOCK[fam], "network_address"), text, F.col("net_link"), F.col("net"), F.col("other_links"))]))
    where = uses.where((F.col("fam") == fam) & F.col("link_pos").isNotNull()).select("arch_id", F.col("link_pos").alias("pos"), "id", "ip").join(seg_links.select("arch_id", "pos", "segment"), ["arch_id", "pos"])
    again = where.groupBy("arch_id", "id", "ip").agg(F.array_sort(F.collect_set("segment")).alias("segs")).where(F.size("segs") > 1).join(known.select("arch_id", "id", "pos"), ["arch_id", "id"])
    text = F.concat(F.lit("Device "), quoted(F.col("id")), F.lit(" uses "), F.col("ip"), F.lit(" on "), F.size("segs").cast("string"), F.lit(" different segments ("), F.array_join("segs", ", "), F.lit("); each interface needs an address of its own segment."))
    parts.append(explode_findings(again, SEGMENTS + 1, F.col("pos"), [finding(F.lit(True), fam, "ip_reused_on_several_links", _at("devices"), text, F.col("id"), F.col("ip"))]))
    return gather(*parts)


def check(devices: DataFrame, links: DataFrame, headers: DataFrame | None = None, require_ipv4: bool = True, families: tuple[int, ...] = (4, 6)) -> DataFrame:
    """All validation findings of all documents. ``families``: those that the documents can hold."""
    known = cut(_known(devices))
    good = cut(valid_links(links, known))
    parts = [document_findings(headers)] if headers is not None else []
    parts += [_device_shape(devices, require_ipv4), duplicate_names(known), _link_shape(links, known)]
    uses, own, used, nets = [], [], [], {}
    for fam in families:
        # parsed once: the rules and all whole-document checks below read these tables
        blocks = cut(device_blocks(devices, fam, require_ipv4))
        ends = cut(link_ends(links, known, fam, require_ipv4))
        parts.append(_device_rules(blocks, fam))
        parts.append(_link_rules(ends, fam))
        full = F.lit(True)
        for f in DEVICE[fam]:
            full = full & F.col("net")[f]["kind"].isNotNull()
        mine = blocks.where(F.col("_on") & full & (F.col("nth") == 0) & F.col("_ip")["canonical"].isNotNull())
        mine = mine.select("arch_id", "id", F.lit(fam).alias("fam"), F.col("_ip")["canonical"].alias("ip"), "pos", _at("devices", BLOCK[fam], "ip_address").alias("path"), F.lit(None).cast("int").alias("link_pos"))
        at_end = ends.where(F.col("device_pos").isNotNull() & F.col("_end")["canonical"].isNotNull())
        at_end = at_end.select("arch_id", F.col("device_id").alias("id"), F.lit(fam).alias("fam"), F.col("_end")["canonical"].alias("ip"), "pos", _at("links", BLOCK[fam], F.concat(F.col("side"), F.lit("_ip"))).alias("path"), F.when(F.col("nth") == 0, F.col("pos")).alias("link_pos"))
        uses += [mine, at_end]
        own.append(mine.select("arch_id", "id", "fam", "ip"))
        used.append(at_end.where("link_pos is not null").groupBy("arch_id", "id", "fam").agg(F.array_sort(F.collect_set("ip")).alias("ips")))
        nets[fam] = ends.where("side = 'source' and nth = 0 and _net is not null").select("arch_id", "pos", F.col("_net").alias("net"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_p").alias("p"))
    every = gather(*uses)
    parts.append(_connectivity(known, good, gather(*own), gather(*used)))
    parts.append(duplicate_addresses(every))
    routed = graph.routing_layer2(graph.link_ends(known, good))
    text = F.concat(F.col("id"), F.lit(" is a "), F.col("type"), F.lit(" but holds addresses in several networks, so it is treated as a layer-3 switch that routes between them."))
    rows = known.join(routed.withColumnRenamed("device", "id"), ["arch_id", "id"], "left_semi")
    parts.append(explode_findings(rows, GRAPH + 8, F.col("pos"), [finding(F.lit(True), 0, "layer2_device_routes", _at("devices"), text, F.col("id"), severity="warning")]))
    seg_links, seg_devices = (cut(x) for x in graph.segments(known, good))
    parts += [_segment_rules(seg_links, seg_devices, nets[fam], fam, every, known) for fam in families]
    return gather(*parts)
