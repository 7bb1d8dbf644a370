"""IPv4 address algebra on Columns. An address is a BIGINT of 0 to 2**32 - 1, or dotted text.

Every function is a built-in expression, so it stays inside whole-stage code
generation; what is not an address gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = 0xFFFFFFFF
_OCTET = r"(?:0|[1-9][0-9]{0,2})"
IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"
CIDR = rf"\A({_OCTET}(?:\.{_OCTET}){{3}})/(0|[1-9][0-9]?)\z"
SUFFIX = r"\A\.([0-9]{1,3})\z"
LAYER2 = ("switch", "bridge", "hub")


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def ip_to_int(text: Column) -> Column:
    """Strict dotted form, no leading zeros."""
    octets = [_long(F.split_part(text, F.lit("."), F.lit(i + 1))) for i in range(4)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(text.rlike(IPV4) & (F.greatest(*octets) <= 255), value)


def int_to_ip(value: Column) -> Column:
    value = value.cast("bigint")
    parts = [F.shiftright(value, n).bitwiseAND(F.lit(255)).cast("string") for n in (24, 16, 8, 0)]
    return F.when(value.between(0, ALL), F.concat_ws(".", *parts))


def is_ipv4(text: Column) -> Column:
    return F.coalesce(ip_to_int(text).isNotNull(), F.lit(False))


def bind(c: Column, use) -> Column:
    """use(c), with c evaluated once; keeps the generated code of nested address expressions small."""
    return F.element_at(F.transform(F.array(c), use), 1)


def mask_of(prefix: Column) -> Column:
    """Mask of a prefix length 0..32, as an integer."""
    shifted = F.call_function("shiftleft", F.lit(ALL).cast("bigint"), (F.lit(32) - prefix).cast("int"))
    return F.when(prefix.between(0, 32), shifted.bitwiseAND(F.lit(ALL)))


def prefix_to_mask(prefix: Column) -> Column:
    return int_to_ip(mask_of(prefix))


def mask_to_prefix(text: Column, zero_ok: bool = False) -> Column:
    """Prefix length of a contiguous mask. Drawn labels exclude 0.0.0.0; documents allow it (``zero_ok``)."""
    value = ip_to_int(text)
    rest = F.lit(ALL).cast("bigint") - value
    good = rest.bitwiseAND(rest + 1) == 0
    return F.when(good & (F.lit(zero_ok) | (value != 0)), F.bit_count(value).cast("int"))


def network_of(value: Column, prefix: Column) -> Column:
    return value.bitwiseAND(mask_of(prefix))


def broadcast_of(value: Column, prefix: Column) -> Column:
    return network_of(value, prefix) + (F.lit(ALL).cast("bigint") - mask_of(prefix))


def ip_in_network(value: Column, base: Column, prefix: Column) -> Column:
    return network_of(value, prefix) == base


def cidr_ip(text: Column) -> Column:
    return F.when(is_cidr(text), F.regexp_extract(text, CIDR, 1))


def cidr_prefix(text: Column) -> Column:
    return F.when(is_cidr(text), F.regexp_extract(text, CIDR, 2).try_cast("int"))


def is_cidr(text: Column) -> Column:
    return text.rlike(CIDR) & is_ipv4(F.regexp_extract(text, CIDR, 1)) & (F.regexp_extract(text, CIDR, 2).try_cast("int") <= 32)


def is_network_form(ip: Column, prefix: Column) -> Column:
    """Host bits all zero, in a block where that address is no host."""
    return (prefix <= 30) & (network_of(ip, prefix) == ip)


def usable_hosts(prefix: Column, family: int = 4) -> Column:
    """Addresses that a segment can give to devices; as DOUBLE beyond IPv4."""
    bits = (F.lit(32 if family == 4 else 128) - prefix).cast("int")
    size = F.pow(F.lit(2.0), bits)
    free = size - (2 if family == 4 else 1)
    out = F.when(bits == 0, 1.0).when(bits == 1, 2.0).otherwise(free)
    return out.cast("bigint") if family == 4 else out


def smallest_prefix(hosts: Column, family: int = 4) -> Column:
    """Longest prefix that holds the hosts: never longer than /30, and /64 for IPv6."""
    if family == 6:
        return F.lit(64)
    out = F.lit(None).cast("int")
    for prefix in range(31):
        out = F.when(hosts <= (1 << (32 - prefix)) - 2, F.lit(prefix)).otherwise(out)
    return out


def origin(**how: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in how.items() for x in pair])


def _address(ip, prefix, mask, network, how) -> Column:
    return F.struct(ip.alias("ip_address"), prefix.cast("int").alias("prefix_length"), mask.alias("subnet_mask"), network.alias("network_address"), how.alias("field_origin"))


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def normalize_cidr(text: Column) -> Column:
    """``192.168.1.1/24`` -> struct of all four fields; NULL if it is none."""
    how = origin(ip_address="ocr", prefix_length="ocr", subnet_mask="derived_from_prefix_length", network_address="derived_from_ip_and_prefix_length")
    parts = F.when(is_cidr(text), F.struct(F.regexp_extract(text, CIDR, 1).alias("ip"), F.regexp_extract(text, CIDR, 2).try_cast("int").alias("prefix")))
    base = lambda k: bind(bind(ip_to_int(k["ip"]), lambda v: network_of(v, k["prefix"])), int_to_ip)
    return bind(parts, lambda k: F.when(k.isNotNull(), _address(k["ip"], k["prefix"], bind(mask_of(k["prefix"]), int_to_ip), base(k), how)))


def normalize_ip_and_mask(ip: Column, mask: Column) -> Column:
    prefix = mask_to_prefix(mask)
    how = origin(ip_address="ocr", subnet_mask="ocr", prefix_length="derived_from_subnet_mask", network_address="derived_from_ip_and_prefix_length")
    return F.when(is_ipv4(ip) & prefix.isNotNull(), _address(ip, prefix, mask, int_to_ip(network_of(ip_to_int(ip), prefix)), how))


def normalize_ip_only(ip: Column) -> Column:
    return F.when(is_ipv4(ip), _address(ip, _null("int"), _null(), _null(), origin(ip_address="ocr")))


def normalize_mask_only(mask: Column) -> Column:
    prefix = mask_to_prefix(mask)
    return F.when(prefix.isNotNull(), _address(_null(), prefix, mask, _null(), origin(subnet_mask="ocr", prefix_length="derived_from_subnet_mask")))


def host_suffix(text: Column) -> Column:
    """``.10`` -> 10, if 0..255."""
    value = F.regexp_extract(text, SUFFIX, 1).try_cast("int")
    return F.when(text.rlike(SUFFIX) & (value <= 255), value)


def host_suffix6(text: Column) -> Column:
    """``::1f`` -> 31: one to four hex digits, not zero."""
    digits = F.regexp_extract(text, r"\A::([0-9A-Fa-f]{1,4})\z", 1)
    value = F.conv(digits, 16, 10).try_cast("int")
    return F.when((digits != "") & (value > 0), value)


def ip_version(text: Column) -> Column:
    """4, 6 (by shape; ``functions.ipv6`` parses strictly) or NULL."""
    return F.when(is_ipv4(text), 4).when(text.rlike(r"\A[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\z"), 6)


def resolve_host_suffix(network: Column, prefix: Column, suffix: Column, least: int = 24, most: int = 31) -> Column:
    """A link's network and a drawn final octet -> struct(address: dotted text or NULL, reason).

    The suffix is the last octet and nothing else, so only prefixes in ``least``..``most``
    resolve.  Reasons are tried in order; IPv6 networks are left to ``functions.ipv6``.
    """
    version = ip_version(network)
    known = F.struct(host_suffix(suffix).alias("value"), host_suffix6(suffix).alias("value6"), ip_to_int(network).alias("base"), version.alias("version"), prefix.cast("int").alias("prefix"), mask_of(prefix).alias("mask"))

    def resolve(k: Column) -> Column:
        base, p = k["base"], k["prefix"]
        family = F.when(k["value"].isNotNull(), 4).when(k["value6"].isNotNull(), 6)
        candidate = base - base % 256 + k["value"]
        last = base + (F.lit(ALL).cast("bigint") - k["mask"])
        reason = (
            F.when(family.isNull(), "invalid_host_suffix")
            .when(k["version"].isNull(), "invalid_network")
            .when(family != k["version"], "suffix_family_mismatch")
            .when(p.isNull() | ~p.between(0, 32), "invalid_network")
            .when(~p.between(least, most), "prefix_outside_final_octet_range")
            .when(base.bitwiseAND(k["mask"]) != base, "network_address_has_host_bits")
            .when(candidate.bitwiseAND(k["mask"]) != base, "suffix_outside_network")
            .when((p <= 30) & ((candidate == base) | (candidate == last)), "suffix_is_network_or_broadcast_address")
            .otherwise("resolved")
        )
        return F.struct(F.when(reason == "resolved", int_to_ip(candidate)).alias("address"), reason.alias("reason"))

    return bind(known, resolve)


def host_problem(ip: Column, prefix: Column) -> Column:
    """Why an address (BIGINT) cannot be a device's: struct(code, severity), the first that holds, or NULL."""
    rest = F.lit(ALL).cast("bigint") - ip
    as_mask = F.when(rest.bitwiseAND(rest + 1) == 0, F.bit_count(ip))
    base, last = network_of(ip, prefix), broadcast_of(ip, prefix)
    code = (
        F.when(as_mask >= 8, "ip_looks_like_mask")
        .when(ip < 16777216, "reserved_ip")  # 0.0.0.0/8
        .when(F.shiftright(ip, 24) == 127, "reserved_ip")
        .when(F.shiftright(ip, 28) == 14, "reserved_ip")  # multicast
        .when(F.shiftright(ip, 28) == 15, "reserved_ip")
        .when((prefix <= 30) & (ip == base), "ip_is_network_address")
        .when((prefix <= 30) & (ip == last), "ip_is_broadcast_address")
        .when(F.shiftright(ip, 16) == 43518, "link_local_ip")  # 169.254.0.0/16
    )
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.when(code == "link_local_ip", "warning").otherwise("error").alias("severity")))


def is_layer2(kind: Column) -> Column:
    return F.coalesce(F.lower(kind).isin(*LAYER2), F.lit(False))
