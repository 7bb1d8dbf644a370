"""Queries over scalar and document functions: addresses, texts, JSON, sinks, contracts and geometry, on rows made by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addr, ipv6
from ..functions import geometry as G
from ..functions.text import named, pointer, quoted
from ..operators import contracts, fusion, plan, readiness
from ..sources import detections, sinks, topology
from . import planted
from .lineage import checkpoint_folder, cut, spread
from .views import dotted


#: What the rows of a table are dealt out by.
KEYS = {"part": "p_partkey", "orders": "o_orderkey", "customer": "c_custkey"}


def _table(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    sql = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **{name: spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name])})


def _ip(v: str) -> str:
    return dotted(v, "duckdb")


# ------------------------------------------------------------------ addresses
def address_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix from 0 to 32, with good, broken and zero masks."""
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, F.pmod(k * F.lit(2654435761), F.lit(1 << 32)).alias("i"), F.pmod(k, F.lit(33)).cast("int").alias("p"))
    mask = F.when(k % 10 == 0, "255.0.255.0").when(k % 10 == 1, "0.0.0.0").otherwise(addr.prefix_to_mask(F.col("p")))
    rows = rows.withColumn("ip", addr.int_to_ip(F.col("i"))).withColumn("mask", mask)
    i, p, ip, m = (F.col(c) for c in ("i", "p", "ip", "mask"))
    cidr, both, alone = addr.normalize_cidr(F.concat(ip, F.lit("/"), p.cast("string"))), addr.normalize_ip_and_mask(ip, m), addr.normalize_mask_only(m)
    how = lambda c: F.array_join(F.transform(F.map_entries(c["field_origin"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select(
        "o_orderkey", addr.ip_to_int(ip).alias("ip_int"), addr.prefix_to_mask(p).alias("prefix_mask"), addr.mask_to_prefix(m).alias("mask_prefix"), addr.mask_to_prefix(m, zero_ok=True).alias("mask_prefix_zero"),
        addr.int_to_ip(addr.network_of(i, p)).alias("network"), addr.int_to_ip(addr.broadcast_of(i, p)).alias("broadcast"), addr.ip_in_network(i, addr.network_of(i + 1, p), p).alias("same_network"), addr.is_network_form(i, p).alias("network_form"),
        addr.usable_hosts(p).alias("usable"), addr.smallest_prefix(k % 70000 + 1).alias("smallest"), cidr["network_address"].alias("cidr_network"), cidr["subnet_mask"].alias("cidr_mask"), both["prefix_length"].alias("both_prefix"), both["network_address"].alias("both_network"),
        how(both).alias("both_origin"), alone["prefix_length"].alias("alone_prefix"), how(alone).alias("alone_origin"), addr.normalize_ip_only(F.concat(ip, F.lit("x")))["ip_address"].alias("no_ip"), addr.ip_version(ip).alias("version"),
    )


FORMS_SQL = f"""
WITH x AS (SELECT o_orderkey, (o_orderkey::HUGEINT * 2654435761 % 4294967296)::BIGINT AS i, (o_orderkey % 33)::INT AS p, o_orderkey % 10 AS c FROM orders),
y AS (SELECT *, 1::BIGINT << (32 - p) AS size, CASE c WHEN 0 THEN 4278255360 WHEN 1 THEN 0 ELSE 4294967296 - (1::BIGINT << (32 - p)) END AS m FROM x),
z AS (SELECT *, CASE WHEN (4294967295 - m) & (4294967296 - m) = 0 THEN bit_count(m)::INT END AS mp, i // size * size AS net FROM y),
w AS (SELECT *, CASE WHEN mp > 0 THEN mp END AS good FROM z)
SELECT o_orderkey, i AS ip_int, {_ip("(4294967296 - size)")} AS prefix_mask, good AS mask_prefix, mp AS mask_prefix_zero, {_ip("net")} AS network, {_ip("(net + size - 1)")} AS broadcast, net = (i + 1) // size * size AND i < 4294967295 OR p = 0 AS same_network,
 p <= 30 AND i = net AS network_form, CASE p WHEN 32 THEN 1 WHEN 31 THEN 2 ELSE size - 2 END AS usable, (SELECT max(q) FROM range(0, 31) AS t(q) WHERE (1::BIGINT << (32 - q)) - 2 >= o_orderkey % 70000 + 1)::INT AS smallest,
 {_ip("net")} AS cidr_network, {_ip("(4294967296 - size)")} AS cidr_mask, good AS both_prefix, CASE WHEN good IS NOT NULL THEN {_ip("(i // (1::BIGINT << (32 - good)) * (1::BIGINT << (32 - good)))")} END AS both_network,
 CASE WHEN good IS NOT NULL THEN 'ip_address=ocr,subnet_mask=ocr,prefix_length=derived_from_subnet_mask,network_address=derived_from_ip_and_prefix_length' END AS both_origin, good AS alone_prefix,
 CASE WHEN good IS NOT NULL THEN 'subnet_mask=ocr,prefix_length=derived_from_subnet_mask' END AS alone_origin, NULL AS no_ip, 4 AS version FROM w"""

V6 = """SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN concat('2001:0DB8:0000:0000:0000:0000:0000:', upper(lpad({h}, 4, '0'))) WHEN 1 THEN concat('FE80::', upper({h})) WHEN 2 THEN concat('2001:db8:', {h}, '::') WHEN 3 THEN concat('2001:db8::1::', {h})
 WHEN 4 THEN concat('fe80::', {h}, '%eth0') WHEN 5 THEN '::' WHEN 6 THEN concat('10.0.0.', p_partkey % 256) ELSE concat('2001:db8:0:0:1:0:0:', {h}) END AS text, {h} AS h FROM part"""


def ipv6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part", V6.format(h="lower(hex(p_partkey % 4000 + 16))"))
    rows = rows.withColumn("network", ipv6.network_of("text", F.lit(64))).withColumn("facts", ipv6.ip_facts("text", F.lit(64))).withColumn("to", ipv6.resolve_suffix("network", F.lit(64), F.pmod("k", F.lit(300))))
    rows = rows.withColumn("canonical", ipv6.canonical("text")).withColumn("version", F.col("facts.version")).withColumn("code", F.col("facts.code"))
    return rows.select("k", "text", "canonical", "network", "version", "code", F.col("to.address").alias("address"), F.col("to.reason").alias("reason"), addr.host_suffix6(F.concat(F.lit("::"), "h")).alias("suffix"), addr.ip_version(F.col("text")).alias("shape"))


V6_SQL = f"""
WITH x AS ({V6.format(h="lower(to_hex(p_partkey % 4000 + 16))")}),
y AS (SELECT *, CASE k % 8 WHEN 0 THEN concat('2001:db8::', h) WHEN 1 THEN concat('fe80::', h) WHEN 2 THEN text WHEN 7 THEN concat('2001:db8::1:0:0:', h) END AS canonical,
 CASE k % 8 WHEN 0 THEN '2001:db8::' WHEN 1 THEN 'fe80::' WHEN 2 THEN text WHEN 5 THEN '::' WHEN 7 THEN '2001:db8::' END AS network FROM x)
SELECT k, text, canonical, network, CASE WHEN k % 8 = 6 THEN 4 WHEN network IS NOT NULL THEN 6 END AS version, CASE k % 8 WHEN 1 THEN 'link_local_ip' WHEN 2 THEN 'ip_is_network_address' WHEN 5 THEN 'reserved_ip' END AS code,
 CASE WHEN network IS NOT NULL THEN concat(network, CASE WHEN k % 300 > 0 THEN lower(to_hex(k % 300)) ELSE '' END) END AS address, CASE WHEN network IS NULL THEN 'invalid_network' ELSE 'resolved' END AS reason, k % 4000 + 16 AS suffix,
 CASE WHEN k % 8 = 6 THEN 4 WHEN k % 8 <> 4 THEN 6 END AS shape FROM y"""

# ------------------------------------------------------------------ texts
TEXTS = """SELECT p_partkey AS k, p_partkey % 90 + 10 AS n, CASE p_partkey % 12 WHEN 0 THEN concat('R', p_partkey % 90 + 10) WHEN 1 THEN concat('10.0.', p_partkey % 90 + 10, '.7/24') WHEN 2 THEN concat('10.0. ', p_partkey % 90 + 10, ' .9') WHEN 3 THEN concat('PC', p_partkey % 90 + 10, ' 10.0.0.', p_partkey % 90 + 10)
 WHEN 4 THEN concat('IP: 10.0.0.', p_partkey % 90 + 10) WHEN 5 THEN concat('hello world', p_partkey % 90 + 10) WHEN 6 THEN concat('R', {wide}, '1') WHEN 7 THEN concat(' .', p_partkey % 90 + 10, '  ') WHEN 8 THEN '255.255.255.0' WHEN 9 THEN concat('Gi0/', p_partkey % 10)
 WHEN 10 THEN concat('2001:db8::', p_partkey % 90 + 10, '/64') ELSE concat('10.0.0.', p_partkey % 90 + 10, {line}, '255.255.255.0') END AS text, CAST(p_partkey % 97 AS DOUBLE) AS x, 0.5 + p_partkey % 50 / 100.0 AS conf FROM part"""


def parsed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in all the ways that they are read, with boxes, address fields and heights."""
    rows = _table(spark, sf_dir, "part", TEXTS.format(wide="substr('０１２３４５６７８９', CAST(p_partkey % 10 AS INT) + 1, 1)", line="'\\n'"))
    x = F.col("x")
    texts = rows.select(F.floor(F.col("k") / 100).alias("image_id"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("text_id"), "text", F.col("conf").cast("double").alias("confidence"), G.rect(x, F.lit(0.0), x + 100, F.lit(20.0)).alias("box"), F.lit(None).cast("array<struct<x: double, y: double>>").alias("polygon"))
    out = fusion.addresses_of(fusion.parse_texts(texts))
    r = lambda c: F.round(c, 6)
    return out.select(
        "image_id", "text_id", "source_id", "text", "kind", r(F.col("semantic")).alias("semantic"), r(F.col("ocr")).alias("ocr"), r(F.col("box.x1")).alias("x1"), r(F.col("box.y1")).alias("y1"), r(F.col("box.x2")).alias("x2"), r(F.col("box.y2")).alias("y2"), "note",
        "ip", "prefix", "mask", "network", "version", "suffix", "network_form", r(F.col("height")).alias("height"),
    )


TEXTS_SQL = f"""
WITH s AS ({TEXTS.format(wide="substr('０１２３４５６７８９', CAST(p_partkey % 10 AS INT) + 1, 1)", line="chr(10)")}),
u AS (SELECT *, k % 12 AS c, concat('t', k) AS id FROM s),
r(k, id, sub, text, kind, semantic, lo, hi, down, note, ip, prefix, mask, network, version, suffix) AS (
SELECT k, id, 0, text, 'device_name', 0.9, 0.0, 1.0, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM u WHERE c = 0
UNION ALL SELECT k, id, 0, text, 'ipv4_cidr', 1.0, 0.0, 1.0, false, NULL, concat('10.0.', n, '.7'), 24, '255.255.255.0', concat('10.0.', n, '.0'), 4, NULL FROM u WHERE c = 1
UNION ALL SELECT k, id, 0, concat('10.0.', n, '.9'), 'ipv4', 0.9, 0.0, 1.0, false, 'whitespace_removed_around_dot_or_slash', concat('10.0.', n, '.9'), NULL, NULL, NULL, 4, NULL FROM u WHERE c = 2
UNION ALL SELECT k, id, 1, concat('PC', n), 'device_name', 0.81, 0.0, 4.0 / length(text), false, 'split_from_multi_token_ocr_region', NULL, NULL, NULL, NULL, NULL, NULL FROM u WHERE c = 3
UNION ALL SELECT k, id, 2, concat('10.0.0.', n), 'ipv4', 0.9, 5.0 / length(text), 1.0, false, 'split_from_multi_token_ocr_region', concat('10.0.0.', n), NULL, NULL, NULL, 4, NULL FROM u WHERE c = 3
UNION ALL SELECT k, id, 0, concat('10.0.0.', n), 'ipv4', 0.85, 0.0, 1.0, false, 'label_prefix_stripped', concat('10.0.0.', n), NULL, NULL, NULL, 4, NULL FROM u WHERE c = 4
UNION ALL SELECT k, id, 0, text, 'unknown', NULL, 0.0, 1.0, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM u WHERE c = 5
UNION ALL SELECT k, id, 0, concat('R', k % 10, '1'), 'device_name', 0.9, 0.0, 1.0, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM u WHERE c = 6
UNION ALL SELECT k, id, 0, trim(text), 'host_suffix', 0.95, 0.0, 1.0, false, NULL, NULL, NULL, NULL, NULL, 4, trim(text) FROM u WHERE c = 7
UNION ALL SELECT k, id, 0, text, 'subnet_mask', 1.0, 0.0, 1.0, false, NULL, NULL, 24, text, NULL, 4, NULL FROM u WHERE c = 8
UNION ALL SELECT k, id, 0, text, 'unknown', NULL, 0.0, 1.0, false, 'ignored_link_type_or_interface_term', NULL, NULL, NULL, NULL, NULL, NULL FROM u WHERE c = 9
UNION ALL SELECT k, id, 0, text, 'ipv6_cidr', 1.0, 0.0, 1.0, false, NULL, split_part(text, '/', 1), 64, NULL, '2001:db8::', 6, NULL FROM u WHERE c = 10
UNION ALL SELECT k, id, 1, concat('10.0.0.', n), 'ipv4', 0.9, 0.0, 0.5, true, 'split_from_multi_token_ocr_region', concat('10.0.0.', n), NULL, NULL, NULL, 4, NULL FROM u WHERE c = 11
UNION ALL SELECT k, id, 2, '255.255.255.0', 'subnet_mask', 0.9, 0.5, 1.0, true, 'split_from_multi_token_ocr_region', NULL, 24, '255.255.255.0', NULL, 4, NULL FROM u WHERE c = 11)
SELECT k // 100 AS image_id, concat(id, CASE WHEN sub > 0 THEN concat('.', sub) ELSE '' END) AS text_id, id AS source_id, r.text, kind, semantic::DOUBLE AS semantic, round(0.5 + k % 50 / 100.0::DOUBLE, 6) AS ocr, round(k % 97 + CASE WHEN down THEN 0 ELSE 100 * lo END, 6)::DOUBLE AS x1,
 round(CASE WHEN down THEN 20 * lo ELSE 0 END, 6)::DOUBLE AS y1, round(k % 97 + CASE WHEN down THEN 100 ELSE 100 * hi END, 6)::DOUBLE AS x2, round(CASE WHEN down THEN 20 * hi ELSE 20 END, 6)::DOUBLE AS y2, note, ip, prefix, mask, network, version, suffix,
 kind = 'ipv6_cidr' AND ip = network AS network_form, CASE WHEN down THEN 10.0 ELSE 20.0 END::DOUBLE AS height FROM r"""

JSONS = """SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN concat('{{"b": [', p_partkey, ', 1.5], "a": {{"x": null}}}}') WHEN 1 THEN concat('{{"a": ', p_partkey, ', "a": 2}}') WHEN 2 THEN concat('[NaN, ', p_partkey, ']') WHEN 3 THEN '{{"a": 1e999}}' WHEN 4 THEN concat('{{"a": ', p_partkey, ',}}')
 WHEN 5 THEN concat(repeat('[', 70), p_partkey, repeat(']', 70)) WHEN 6 THEN concat('"text ', p_partkey, '"') WHEN 7 THEN concat(repeat('[', 60), p_partkey, repeat(']', 60)) ELSE concat('{{"é": "ü", "k": ', p_partkey, '}}') END AS raw FROM part""".replace("{{", "{").replace("}}", "}")


def json_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictness problems, canonical forms and revisions of JSON texts."""
    rows = _table(spark, sf_dir, "part", JSONS).withColumn("bad", sinks.json_problem("raw")).withColumn("canonical", sinks.canonical_json("raw"))
    return rows.select("k", F.col("bad.code").alias("code"), F.col("bad.path").alias("path"), "canonical", sinks.revision(F.col("raw")).alias("revision"), pointer(F.concat(F.lit("a/b~"), F.col("k").cast("string"))).alias("step"), quoted(F.concat(F.lit("it's "), F.col("k").cast("string"))).alias("shown"), named(F.when(F.col("k") % 2 == 0, " \t").otherwise("x")).alias("named"))


JSONS_SQL = f"""
WITH x AS ({JSONS}),
y AS (SELECT *, CASE k % 9 WHEN 0 THEN concat('{{"a":{{"x":null}},"b":[', k, ',1.5]}}') WHEN 5 THEN raw WHEN 6 THEN raw WHEN 7 THEN raw WHEN 8 THEN concat('{{"k":', k, ',"é":"ü"}}') END AS canonical FROM x)
SELECT k, CASE WHEN k % 9 IN (1, 2, 3, 4) THEN 'invalid_json_value' WHEN k % 9 = 5 THEN 'json_nesting_limit' END AS code, CASE WHEN k % 9 IN (1, 2, 3, 4) THEN '' WHEN k % 9 = 5 THEN repeat('/0', 65) END AS path, canonical, sha256(canonical) AS revision,
 concat('a~1b~0', k) AS step, concat('"it''s ', k, '"') AS shown, k % 2 = 1 AS named FROM y"""


# ------------------------------------------------------------------ documents, sinks and contracts
ODD_RAW = ["[]", '{"devices": [], "links": []}', '{"devices": 5}', "not json", '{"devices":[{}],"links":[1]}', '{"a":1,"a":2}', '{"devices":[{"id":"x"}],"links":[],"n":1e999}']
ODD_FOUND = [
    [("invalid_architecture", "")], [("missing_devices", "/devices"), ("missing_links", "/links")], [("missing_devices", "/devices"), ("missing_links", "/links")], [("invalid_architecture", "")],
    [(f"missing_device_{f}", f"/devices/0/{f}") for f in ("id", "name", "type", "network")] + [("invalid_link", "/links/0")] + [("unknown_device", f"/links/0/{s}") for s in ()], [("invalid_architecture", "")],
    [(f"missing_device_{f}", f"/devices/0/{f}") for f in ("name", "type", "network")] + [("isolated_device", "/devices/0"), ("invalid_json_value", "")],
]


def _raw(devices: DataFrame, links: DataFrame) -> DataFrame:
    """(arch_id, raw) of the planted documents, written out as JSON text."""
    value = lambda f: F.when(f["kind"] == "STRING", F.concat(F.lit('"'), f["text"], F.lit('"'))).when(f["kind"].isNotNull(), f["text"]).otherwise("null")
    text = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit('"'), F.col(c), F.lit('"'))).otherwise("null")

    def block(name: str, fields: tuple[str, ...]) -> Column:
        inner = F.concat_ws(",", *[F.concat(F.lit(f'"{f}":'), value(F.col(name)[f])) for f in fields])
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(f',"{name}":{{'), inner, F.lit("}"))).otherwise("")

    def listed(rows: DataFrame, names: tuple[str, ...], fields: dict[str, tuple[str, ...]], out: str) -> DataFrame:
        body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), text(n)) for n in names]), *[block(b, f) for b, f in fields.items()], F.lit("}"))
        entry = F.struct("pos", F.when(F.col("is_object"), body).otherwise("7").alias("j"))
        return rows.groupBy("arch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["j"]), ",").alias(out))

    four6 = ("ip_address", "prefix_length", "subnet_mask", "network_address")
    link = ("network_address", "prefix_length", "subnet_mask", "source_ip", "target_ip")
    both = listed(devices, ("id", "name", "type"), {"network": four6, "network6": four6}, "d").join(listed(links, ("id", "source", "target"), {"network": link, "network6": link}, "l"), "arch_id")
    return both.select("arch_id", F.concat(F.lit('{"devices":['), "d", F.lit('],"links":['), "l", F.lit("]}")).alias("raw"))


def parsed_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness findings of documents read from JSON text, odd ones among them."""
    odd = spark.read.parquet(f"{sf_dir}/nation.parquet").select((-1 - F.col("n_nationkey")).cast("long").alias("arch_id"), F.element_at(F.array(*[F.lit(x) for x in ODD_RAW]), (F.col("n_nationkey") % len(ODD_RAW) + 1).cast("int")).alias("raw"))
    docs = topology.parse(cut(_raw(*planted.tables(spark, sf_dir)).unionByName(odd)))  # devices, links and headers are each read from it
    return readiness.check(topology.devices(docs), topology.links(docs), topology.headers(docs)).select("arch_id", "code", "path")


_CASES = " UNION ALL ".join(f"SELECT -1 - n_nationkey, '{code}', '{path}' FROM nation WHERE n_nationkey % {len(ODD_RAW)} = {i}" for i, found in enumerate(ODD_FOUND) for code, path in found)
PARSED_SQL = planted.READINESS_SQL + f" UNION ALL {_CASES}"


def written_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written twice to one place in the shared folder, and read again."""
    path = f"{spark.sparkContext.getCheckpointDir() or checkpoint_folder(spark)}/findings-of-{abs(hash(sf_dir))}"
    found = cut(readiness.check(*planted.tables(spark, sf_dir)))  # written twice below
    sinks.write_findings(found.where("code = 'isolated_device'"), path)
    sinks.write_findings(found, path)
    return spark.read.parquet(path).select("arch_id", "code", "path")


def kept_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first version stays, whatever comes later."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return sinks.keep_first(orders.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("first")), orders.where("o_orderkey % 2 = 0"), "o_orderkey")


KEPT_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'first' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0"

IDS = "SELECT CAST(p_partkey % 40 AS INT) AS image_id, CASE WHEN p_partkey % 40 % 5 = 0 AND p_partkey % 80 < 40 THEN concat('device_', p_partkey) WHEN p_partkey % 40 % 5 = 0 THEN concat('device_0', p_partkey - 40) WHEN p_partkey % 40 % 5 = 1 THEN concat('host-', p_partkey) ELSE concat('link_00', p_partkey) END AS id FROM part"


def shortened_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ids, unless two of an image would collide."""
    return contracts.short_ids(_table(spark, sf_dir, "part", IDS)).select("image_id", "id", "short")


SHORT_SQL = f"""
WITH x AS ({IDS}), y AS (SELECT *, CASE WHEN regexp_full_match(id, '[A-Za-z]+_[0-9]+') THEN concat(split_part(id, '_', 1), '_', split_part(id, '_', 2)::BIGINT) ELSE id END AS s FROM x)
SELECT image_id, id, CASE WHEN count(DISTINCT s) OVER (PARTITION BY image_id) = count(DISTINCT id) OVER (PARTITION BY image_id) THEN s ELSE id END AS short FROM y"""

HELD = """SELECT CAST(p_partkey % 50 AS INT) AS image_id, concat('d', p_partkey // 3) AS device_id, CASE WHEN p_partkey % 3 = 0 THEN concat('10.0.0.', p_partkey % 200) WHEN p_partkey % 15 = 1 THEN concat('10.1.0.', p_partkey % 200) END AS ip, CASE WHEN p_partkey % 3 = 0 THEN 24 END AS prefix,
 CASE WHEN p_partkey % 15 = 2 THEN '255.255.0.0' END AS mask, 4 AS version, CASE WHEN p_partkey % 3 > 0 THEN concat('.', p_partkey % 200) END AS suffix FROM part"""


def mirrored_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one substantive address of each device, or none."""
    rows = _table(spark, sf_dir, "part", HELD.replace("p_partkey // 3", "p_partkey div 3").replace("CAST(p_partkey % 50 AS INT)", "CAST(p_partkey div 3 % 50 AS INT)")).withColumn("network", F.lit("10.0.0.0"))
    return contracts.mirror(rows).select("image_id", "device_id", "ip", "prefix", "mask", "network", "suffix")


MIRROR_SQL = f"""
WITH x AS ({HELD.replace("CAST(p_partkey % 50 AS INT)", "CAST(p_partkey // 3 % 50 AS INT)")}),
y AS (SELECT *, count(*) FILTER (ip IS NOT NULL OR mask IS NOT NULL) OVER (PARTITION BY image_id, device_id) AS solid, count(*) OVER (PARTITION BY image_id, device_id) AS n, ip IS NOT NULL OR mask IS NOT NULL AS own FROM x),
z AS (SELECT * FROM y WHERE solid = 1 AND own OR solid = 0 AND n = 1)
SELECT d.image_id, d.device_id, ip, prefix, mask, CASE WHEN z.device_id IS NOT NULL THEN '10.0.0.0' END AS network, suffix FROM (SELECT DISTINCT image_id, device_id FROM x) d LEFT JOIN z USING (image_id, device_id)"""

EDGES = """SELECT CAST(p_partkey % 50 AS INT) AS image_id, concat('link_', CASE WHEN p_partkey % 91 = 0 THEN p_partkey - 50 ELSE p_partkey END) AS link_id, CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'nowhere' ELSE concat('d', p_partkey % 7) END AS source, CASE WHEN p_partkey % 11 = 0 THEN concat('d', p_partkey % 7) ELSE concat('d', p_partkey % 5) END AS target FROM part"""


def reference_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids, unknown ends and links to themselves."""
    links = _table(spark, sf_dir, "part", EDGES)
    images = links.select("image_id").distinct()
    devices = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n")).select("image_id", F.concat(F.lit("d"), F.col("n").cast("string")).alias("device_id"))
    return contracts.reference_problems(devices, links)


REFERENCE_SQL = f"""
WITH l AS ({EDGES}), d AS (SELECT image_id, concat('d', n) AS id FROM (SELECT DISTINCT image_id FROM l) CROSS JOIN range(0, 6) AS r(n)),
e AS (SELECT image_id, link_id, source AS id FROM l WHERE source IS NOT NULL UNION ALL SELECT image_id, link_id, target FROM l)
SELECT image_id, link_id AS id, 'duplicate_id' AS problem FROM l GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT image_id, link_id, 'unknown_device' FROM e ANTI JOIN d ON d.image_id = e.image_id AND d.id = e.id
UNION ALL SELECT image_id, link_id, 'self_link' FROM l WHERE source = target UNION ALL SELECT image_id, link_id, 'missing_source' FROM l WHERE source IS NULL"""


def block_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address blocks whose parts do not agree."""
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(k)
    c = k % 7
    p = F.when(c == 0, 40).when(c == 3, F.lit(None).cast("int")).otherwise(k % 25 + 8).cast("int")
    base = addr.int_to_ip(addr.network_of(k * 4099 % (1 << 31) + 16777216, F.coalesce(p, F.lit(8))))
    ip = addr.int_to_ip(k * 4099 % (1 << 31) + 16777216)
    rows = rows.select(k, ip.alias("ip"), p.alias("prefix"), F.when(c == 1, "255.255.255.255").when(c != 0, addr.prefix_to_mask(p)).alias("mask"), F.when(c == 4, "9.9.9.9").when(c != 5, base).alias("network"), F.when(c == 6, 6).otherwise(4).alias("version"))
    return rows.select("p_partkey", contracts.block_problem(F.col("ip"), F.col("prefix"), F.col("mask"), F.col("network"), F.col("version"), addr.prefix_to_mask(F.col("prefix"))).alias("problem"))


BLOCK_SQL = """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'prefix_out_of_range' WHEN 6 THEN 'mask_on_ipv6' WHEN 1 THEN CASE WHEN p_partkey % 25 + 8 < 32 THEN 'mask_does_not_match_prefix' END WHEN 3 THEN 'network_without_prefix' WHEN 4 THEN 'network_does_not_match_address' END AS problem FROM part"""


def plan_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a plan against the required ones: missing, unexpected, of another type or value."""
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((k % 100).alias("arch_id"), F.concat(F.lit("/a/"), k.cast("string")).alias("path"), k)
    required = rows.where(k % 7 != 0).select("arch_id", "path", F.lit("int").alias("kind"), k.cast("string").alias("text"))
    actual = rows.where(k % 11 != 0).select("arch_id", "path", F.when(k % 13 == 0, "str").otherwise("int").alias("kind"), F.when(k % 17 == 0, "0").otherwise(k.cast("string")).alias("text"))
    return plan.differences(actual, required)


DIFFERENCE_SQL = """
SELECT o_orderkey % 100 AS arch_id, concat('/a/', o_orderkey) AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'unexpected' WHEN o_orderkey % 13 = 0 THEN 'type' ELSE 'value' END AS problem FROM orders
WHERE (o_orderkey % 11 = 0) <> (o_orderkey % 7 = 0) OR o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND (o_orderkey % 13 = 0 OR o_orderkey % 17 = 0)"""

# ------------------------------------------------------------------ detector documents
BOX = "[{0} % 90 - 5, {0} % 50, {0} % 90 + 20 + {0} % 9, {0} % 50 + 30]"


def _detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, raw) with devices, texts and cables in one document for each hundred parts."""
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(k, F.floor(k / 100).alias("image_id"))
    s = lambda x: x.cast("string")
    box = F.concat(F.lit("["), s(k % 90 - 5), F.lit(","), s(k % 50), F.lit(","), s(k % 90 + 20 + k % 9), F.lit(","), s(k % 50 + 30), F.lit("]"))
    polygon = F.concat(F.lit("[["), s(k % 90), F.lit(","), s(k % 50), F.lit("],["), s(k % 90 + 40), F.lit(","), s(k % 50), F.lit("],["), s(k % 90 + 40), F.lit(","), s(k % 50 + 12), F.lit("]]"))
    device = F.concat(F.lit('{"id":"d'), s(k), F.lit('"'), F.when(k % 9 == 0, "").otherwise(',"class":"pc"'), F.lit(',"confidence":'), s(k % 100 / 100), F.lit(',"bbox":'), box, F.lit("}"))
    text = F.concat(F.lit('{"id":"t'), s(F.when(k % 31 == 0, k - 1).otherwise(k)), F.lit('","text":"R'), s(k), F.lit('","confidence":0.5,"bbox":'), F.when(k % 4 == 0, "null").otherwise(box), F.lit(',"polygon":'), polygon, F.lit("}"))
    cable = F.concat(F.lit('{"id":"c'), s(k), F.lit('","segments":[[['), s(k % 7), F.lit(",1],["), s(k % 7 + 9), F.lit(',5]]],"polyline":[['), s(k % 7), F.lit(",1],["), s(k % 7 + 9), F.lit(',5]],"path_type":"single","start":['), s(k % 7), F.lit(',1],"end":null,"endpoints":[],"confidence":0.9,"quality":{"ink":0.5}}'))
    lists = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, x.alias("j")))), lambda e: e["j"]), ",") for x in (device, text, cable)]
    docs = rows.groupBy("image_id").agg(*[x.alias(n) for x, n in zip(lists, "dtc", strict=True)])
    image = F.concat(F.lit('{"image":{"path":"i'), s(F.col("image_id")), F.lit('","width":100,"height":70}'))
    return docs.select("image_id", F.concat(image, F.lit(',"detections":['), "d", F.lit('],"texts":['), "t", F.lit('],"link_candidates":['), "c", F.lit("]}")).alias("raw"))


def detected_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device boxes read from detector documents and clipped to their image."""
    raw = _detector(spark, sf_dir)
    fitted, _ = detections.fit(detections.devices(raw), detections.images(raw))
    return fitted.select("image_id", "device_id", "class", "confidence", "box.*")


DETECTED_SQL = """
SELECT * FROM (SELECT p_partkey // 100 AS image_id, concat('d', p_partkey) AS device_id, CASE WHEN p_partkey % 9 > 0 THEN 'pc' END AS class, p_partkey % 100 / 100.0::DOUBLE AS confidence, greatest(0, p_partkey % 90 - 5)::DOUBLE AS x1, (p_partkey % 50)::DOUBLE AS y1,
 least(100, p_partkey % 90 + 20 + p_partkey % 9)::DOUBLE AS x2, least(70, p_partkey % 50 + 30)::DOUBLE AS y2 FROM part) WHERE x2 > x1 AND y2 > y1"""


def detector_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with detector documents: boxes outside the image, missing values and repeated ids."""
    raw = _detector(spark, sf_dir)
    devices, texts = detections.devices(raw), detections.texts(raw)
    _, outside = detections.fit(devices, detections.images(raw))
    found = detections.schema_errors(devices, "device_id", ["class", "box"]).select("image_id", F.col("device_id").alias("id"), "problem")
    found = found.unionByName(detections.schema_errors(texts, "text_id", ["text"]).select("image_id", F.col("text_id").alias("id"), "problem"))
    return found.unionByName(outside.select("image_id", F.round("overshoot", 6).cast("string").alias("id"), F.col("code").alias("problem")))


WARNING_SQL = """
SELECT p_partkey // 100 AS image_id, concat('d', p_partkey) AS id, 'missing_class' AS problem FROM part WHERE p_partkey % 9 = 0
UNION ALL SELECT p_partkey // 100, concat('t', p_partkey - 1), 'duplicate_id' FROM part WHERE p_partkey % 31 = 0 AND (p_partkey - 1) // 100 = p_partkey // 100 AND p_partkey > 1 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey - 1)
UNION ALL SELECT image_id, over::DOUBLE::VARCHAR, 'bbox_outside_image' FROM (SELECT p_partkey // 100 AS image_id, greatest(5 - p_partkey % 90, -(p_partkey % 50), p_partkey % 90 + 20 + p_partkey % 9 - 100, p_partkey % 50 + 30 - 70) AS over FROM part) WHERE over > 4"""


def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read from documents, boxes from polygons where there are none; and cables."""
    raw = _detector(spark, sf_dir)
    texts = detections.texts(raw).select("image_id", F.col("text_id").alias("id"), "text", "box.*", F.size("polygon").alias("points"))
    cables = detections.cables(raw)
    p, q = F.col("segments")[0]["p1"], F.col("segments")[0]["p2"]
    lines = cables.select("image_id", F.col("candidate_id").alias("id"), F.col("path_type").alias("text"), p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"), (F.size("polyline") + F.size("endpoints") + F.when(F.col("end").isNull(), 10).otherwise(0) + (F.col("start.x") == p["x"]).cast("int") * 100).alias("points"))
    return texts.unionByName(lines)


READ_SQL = """
SELECT p_partkey // 100 AS image_id, concat('t', CASE WHEN p_partkey % 31 = 0 THEN p_partkey - 1 ELSE p_partkey END) AS id, concat('R', p_partkey) AS text, (p_partkey % 90 - CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 5 END)::DOUBLE AS x1, (p_partkey % 50)::DOUBLE AS y1,
 CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 90 + 40 ELSE p_partkey % 90 + 20 + p_partkey % 9 END::DOUBLE AS x2, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 50 + 12 ELSE p_partkey % 50 + 30 END::DOUBLE AS y2, 3 AS points FROM part
UNION ALL SELECT p_partkey // 100, concat('c', p_partkey), 'single', (p_partkey % 7)::DOUBLE, 1.0::DOUBLE, (p_partkey % 7 + 9)::DOUBLE, 5.0::DOUBLE, 112 FROM part"""


def model_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's and a text reader's parallel arrays as rows, numbered."""
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.floor(k / 20).alias("image_id"), k)
    at = k % 20
    box = F.array((at * 30).cast("double"), F.floor(at / 5) * 100.0, at * 30 + 20.0, F.floor(at / 5) * 100.0 + 20)
    pack = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-k).alias("o"), c.alias("v")))), lambda e: e["v"])
    boxes = rows.groupBy("image_id").agg(pack(box).alias("boxes"), pack(k / 10000.0).alias("scores"), pack(F.concat(F.lit("c"), (k % 3).cast("string"))).alias("labels"))
    found = detections.model_rows(boxes).select("image_id", F.col("device_id").alias("id"), F.col("class").alias("label"), "confidence", "box.x1", "box.y2")
    polygon = F.when(k % 6 == 0, F.array().cast("array<array<double>>")).otherwise(F.array(F.array(at * 1.0, F.lit(0.0)), F.array(at + 5.0, F.lit(9.0))))
    texts = rows.groupBy("image_id").agg(pack(F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit("T"), k.cast("string")))).alias("texts"), pack(k / 10000.0).alias("scores"), pack(polygon).alias("polygons"))
    return found.unionByName(detections.text_rows(texts).select("image_id", F.col("text_id").alias("id"), F.col("text").alias("label"), "confidence", "box.x1", "box.y2"))


MODEL_SQL = """
WITH x AS (SELECT p_partkey AS k, p_partkey // 20 AS image_id, p_partkey % 20 AS spot FROM part),
y AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY spot // 5, spot) AS place, row_number() OVER (PARTITION BY image_id ORDER BY -k) AS n FROM x)
SELECT image_id, concat('device_', lpad(place::VARCHAR, 3, '0')) AS id, concat('c', k % 3) AS label, k / 10000.0::DOUBLE AS confidence, (spot * 30)::DOUBLE AS x1, (spot // 5 * 100 + 20)::DOUBLE AS y2 FROM y
UNION ALL SELECT image_id, concat('text_', lpad(n::VARCHAR, 3, '0')), concat('T', k), k / 10000.0::DOUBLE, spot::DOUBLE, 9.0::DOUBLE FROM y WHERE k % 5 > 0 AND k % 6 > 0"""

# ------------------------------------------------------------------ geometry
PAIR = """SELECT p_partkey AS k, CAST(p_partkey * 13 % 101 AS DOUBLE) AS ax1, CAST(p_partkey * 17 % 103 AS DOUBLE) AS ay1, CAST(p_partkey * 13 % 101 + 5 + p_size AS DOUBLE) AS ax2, CAST(p_partkey * 17 % 103 + 7 + p_size % 11 AS DOUBLE) AS ay2,
 CAST(p_partkey * 19 % 107 AS DOUBLE) AS bx1, CAST(p_partkey * 23 % 109 AS DOUBLE) AS by1, CAST(p_partkey * 19 % 107 + 9 + p_size % 13 AS DOUBLE) AS bx2, CAST(p_partkey * 23 % 109 + 3 + p_size AS DOUBLE) AS by2 FROM part"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    rows = _table(spark, sf_dir, "part", PAIR)
    box = lambda n: G.rect(*[F.col(f"{n}{c}") for c in ("x1", "y1", "x2", "y2")])
    return rows, box("a"), box("b")


def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, a, b = _boxes(spark, sf_dir)
    show = lambda r: F.concat_ws(",", *[F.round(r[c], 3).cast("string") for c in ("x1", "y1", "x2", "y2")])
    small = G.shrink_ratio(a, 0.3, 4.0)
    dx, dy = G.separations(a, b)
    seg, far = G.segment(G.point(F.col("ax1"), F.col("ay1")), G.point(F.col("bx1"), F.col("by1"))), G.segment(G.point(F.col("ax2"), F.col("ay1")), G.point(F.col("bx1"), F.col("by2")))
    u = G.unit(seg["p1"], seg["p2"])
    return rows.select(
        "k", show(G.union(a, b)).alias("whole"), show(G.expand(a, 2.5)).alias("wider"), F.when(small.isNotNull(), show(small)).alias("smaller"), show(G.clip(a, F.lit(90), F.lit(80))).alias("clipped"), G.contains_point(a, G.center(b), 1.0).alias("holds_center"), G.contains_rect(a, b, 20.0).alias("holds"),
        F.round(G.gap(a, b), 6).alias("gap"), F.round(dx, 6).alias("dx"), F.round(dy, 6).alias("dy"), F.round(G.iou(a, b), 6).alias("iou"), F.round(G.size(a), 6).alias("size"), F.round(G.seg_angle(seg), 6).alias("angle"), F.round(G.angle_diff(G.seg_angle(seg), G.seg_angle(far)), 6).alias("turn"),
        F.round(u["x"], 6).alias("ux"), F.round(u["y"], 6).alias("uy"), G.relative_location(a, b).alias("place"),
    )


_SHOW = "concat_ws(',', {0}, {1}, {2}, {3})"
_R3 = lambda x: f"round({x}, 3)::DOUBLE"
BOX_SQL = f"""
WITH x AS ({PAIR}),
y AS (SELECT *, greatest((ax2 - ax1) * 0.3::DOUBLE, 4.0) AS sx, greatest((ay2 - ay1) * 0.3::DOUBLE, 4.0) AS sy, greatest(0.0, bx1 - ax2, ax1 - bx2) AS dx, greatest(0.0, by1 - ay2, ay1 - by2) AS dy, greatest(0.0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0.0, least(ay2, by2) - greatest(ay1, by1)) AS inter,
 (atan2(by1 - ay1, bx1 - ax1) + 2 * pi()) % pi() AS t1, (atan2(by2 - ay1, bx1 - ax2) + 2 * pi()) % pi() AS t2, sqrt((bx1 - ax1) ** 2 + (by1 - ay1) ** 2) AS len, (ax1 + ax2) / 2 AS acx, (ay1 + ay2) / 2 AS acy, (bx1 + bx2) / 2 AS bcx, (by1 + by2) / 2 AS bcy FROM x)
SELECT k, {_SHOW.format(*map(_R3, ("least(ax1, bx1)", "least(ay1, by1)", "greatest(ax2, bx2)", "greatest(ay2, by2)")))} AS whole, {_SHOW.format(*map(_R3, ("ax1 - 2.5", "ay1 - 2.5", "ax2 + 2.5", "ay2 + 2.5")))} AS wider,
 CASE WHEN ax2 - ax1 - 2 * sx > 0 AND ay2 - ay1 - 2 * sy > 0 THEN {_SHOW.format(*map(_R3, ("ax1 + sx", "ay1 + sy", "ax2 - sx", "ay2 - sy")))} END AS smaller, {_SHOW.format(*map(_R3, ("greatest(0, ax1)", "greatest(0, ay1)", "least(90, ax2)", "least(80, ay2)")))} AS clipped,
 bcx BETWEEN ax1 - 1 AND ax2 + 1 AND bcy BETWEEN ay1 - 1 AND ay2 + 1 AS holds_center, bx1 >= ax1 - 20 AND by1 >= ay1 - 20 AND bx2 <= ax2 + 20 AND by2 <= ay2 + 20 AS holds, round(sqrt(dx ** 2 + dy ** 2), 6) AS gap, round(dx, 6)::DOUBLE AS dx, round(dy, 6)::DOUBLE AS dy,
 round(inter / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter), 6) AS iou, greatest(ax2 - ax1, ay2 - ay1, 1.0)::DOUBLE AS size, round(t1, 6) AS angle, round(least(abs(t1 - t2), pi() - abs(t1 - t2)), 6) AS turn, round(CASE WHEN len < 1e-9 THEN 0 ELSE (bx1 - ax1) / len END, 6)::DOUBLE AS ux, round(CASE WHEN len < 1e-9 THEN 0 ELSE (by1 - ay1) / len END, 6)::DOUBLE AS uy,
 CASE WHEN dx = 0 AND dy = 0 THEN 'inside' WHEN dx > 0 AND dy > 0 THEN 'diagonal' WHEN dy > 0 AND acy > bcy THEN 'below' WHEN dy > 0 THEN 'above' WHEN acx > bcx THEN 'right' ELSE 'left' END AS place FROM y"""


def segment_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments against rectangles and each other, rays and polylines; some stand upright or lie flat."""
    rows, a, _ = _boxes(spark, sf_dir)
    x2, y2 = F.when(F.col("k") % 6 == 0, F.col("bx1")).otherwise(F.col("bx2") + 40), F.when(F.col("k") % 6 == 1, F.col("by1")).otherwise(F.col("by2") - 60)
    p, q, r = G.point(F.col("bx1"), F.col("by1")), G.point(x2, y2), G.point(F.col("ax2"), F.col("by2"))
    s, other = G.segment(p, q), G.segment(G.point(F.col("ax1"), F.col("ay1")), G.point(F.col("ax2"), F.col("ay2")))
    way, cut = G.point(q["x"] - p["x"], q["y"] - p["y"]), G.clip_segment_to_rect(s, a)
    line = F.array(p, q, r)
    middle, near = G.polyline_midpoint(line), G.rect_polyline(a, G.polyline_segments(line))
    round6 = lambda c: F.round(c, 6)
    return rows.select(
        "k", G.segments_intersect(s, other).alias("crosses"), round6(cut["p1"]["x"]).alias("cx1"), round6(cut["p1"]["y"]).alias("cy1"), round6(cut["p2"]["x"]).alias("cx2"), round6(cut["p2"]["y"]).alias("cy2"), round6(G.seg_rect_distance(s, a)).alias("away"),
        round6(G.ray_rect_entry(p, way, a) * G.dist(p, q)).alias("entry"), round6(G.polyline_length(line)).alias("length"), round6(middle["x"]).alias("mx"), round6(middle["y"]).alias("my"), round6(near["distance"]).alias("nearest"), near["index"].alias("nearest_at"),
    )


def _clip(sx: str, sy: str, ex: str, ey: str) -> tuple[str, str, str]:
    """first and last parameter of a segment within box a, and whether there is one."""
    slab = lambda o, d, lo, hi, f: f"CASE WHEN abs({d}) >= 1e-9 THEN {f}(({lo} - {o}) / ({d}), ({hi} - {o}) / ({d})) END"
    dx, dy = f"({ex} - {sx})", f"({ey} - {sy})"
    first = f"greatest(0.0, {slab(sx, dx, 'ax1', 'ax2', 'least')}, {slab(sy, dy, 'ay1', 'ay2', 'least')})"
    last = f"least(1.0, {slab(sx, dx, 'ax1', 'ax2', 'greatest')}, {slab(sy, dy, 'ay1', 'ay2', 'greatest')})"
    ok = f"NOT (abs({dx}) < 1e-9 AND ({sx} < ax1 OR {sx} > ax2)) AND NOT (abs({dy}) < 1e-9 AND ({sy} < ay1 OR {sy} > ay2)) AND {first} <= {last}"
    return first, last, ok


def _point_seg(px: str, py: str, sx: str, sy: str, ex: str, ey: str) -> str:
    dx, dy = f"({ex} - {sx})", f"({ey} - {sy})"
    t = f"CASE WHEN {dx} ** 2 + {dy} ** 2 < 1e-9 THEN 0 ELSE least(1, greatest(0, (({px} - {sx}) * {dx} + ({py} - {sy}) * {dy}) / ({dx} ** 2 + {dy} ** 2))) END"
    return f"(SELECT sqrt(({px} - {sx} - t * {dx}) ** 2 + ({py} - {sy} - t * {dy}) ** 2) FROM (SELECT {t} AS t))"


def _away(sx: str, sy: str, ex: str, ey: str) -> str:
    corners = [_point_seg(x, y, sx, sy, ex, ey) for x in ("ax1", "ax2") for y in ("ay1", "ay2")]
    ends = [f"sqrt(greatest(ax1 - {x}, 0, {x} - ax2) ** 2 + greatest(ay1 - {y}, 0, {y} - ay2) ** 2)" for x, y in ((sx, sy), (ex, ey))]
    return f"CASE WHEN {_clip(sx, sy, ex, ey)[2]} THEN 0.0 ELSE least({', '.join([*ends, *corners])}) END"


_FIRST, _LAST, _SOME = _clip("px", "py", "qx", "qy")
_TURN = lambda a, b, c: f"(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"
SEGMENT_SQL = f"""
WITH x AS ({PAIR}),
y AS (SELECT *, bx1 AS px, by1 AS py, CASE WHEN k % 6 = 0 THEN bx1 ELSE bx2 + 40 END AS qx, CASE WHEN k % 6 = 1 THEN by1 ELSE by2 - 60 END AS qy, ax2 AS rx, by2 AS ry, ax1 AS ux, ay1 AS uy, ax2 AS vx, ay2 AS vy FROM x),
z AS (SELECT *, {_FIRST} AS t0, {_LAST} AS t1, {_SOME} AS has, sqrt((qx - px) ** 2 + (qy - py) ** 2) AS l1, sqrt((rx - qx) ** 2 + (ry - qy) ** 2) AS l2, {_away("px", "py", "qx", "qy")} AS d0, {_away("qx", "qy", "rx", "ry")} AS d1,
 greatest(0.0, CASE WHEN abs(qx - px) >= 1e-9 THEN least((ax1 - px) / (qx - px), (ax2 - px) / (qx - px)) END, CASE WHEN abs(qy - py) >= 1e-9 THEN least((ay1 - py) / (qy - py), (ay2 - py) / (qy - py)) END) AS r0,
 least(CASE WHEN abs(qx - px) >= 1e-9 THEN greatest((ax1 - px) / (qx - px), (ax2 - px) / (qx - px)) END, CASE WHEN abs(qy - py) >= 1e-9 THEN greatest((ay1 - py) / (qy - py), (ay2 - py) / (qy - py)) END) AS r1 FROM y),
w AS (SELECT *, (l1 + l2) / 2 AS half FROM z)
SELECT k, {_TURN("u", "v", "p")} * {_TURN("u", "v", "q")} < 0 AND {_TURN("p", "q", "u")} * {_TURN("p", "q", "v")} < 0 AS crosses, CASE WHEN has THEN round(px + t0 * (qx - px), 6) END AS cx1, CASE WHEN has THEN round(py + t0 * (qy - py), 6) END AS cy1, CASE WHEN has THEN round(px + t1 * (qx - px), 6) END AS cx2,
 CASE WHEN has THEN round(py + t1 * (qy - py), 6) END AS cy2, round(d0, 6) AS away, CASE WHEN px BETWEEN ax1 AND ax2 AND py BETWEEN ay1 AND ay2 THEN 0.0 WHEN l1 >= 1e-9 AND r0 <= r1 AND NOT (abs(qx - px) < 1e-9 AND (px < ax1 OR px > ax2)) AND NOT (abs(qy - py) < 1e-9 AND (py < ay1 OR py > ay2)) THEN round(r0 * l1, 6) END::DOUBLE AS entry,
 round(l1 + l2, 6) AS length, round(CASE WHEN l1 >= half THEN px + half / l1 * (qx - px) ELSE qx + (half - l1) / l2 * (rx - qx) END, 6) AS mx, round(CASE WHEN l1 >= half THEN py + half / l1 * (qy - py) ELSE qy + (half - l1) / l2 * (ry - qy) END, 6) AS my, round(least(d0, d1), 6) AS nearest, CASE WHEN d0 <= d1 THEN 0 ELSE 1 END AS nearest_at FROM w"""

CATALOGUE: dict[str, tuple] = {
    "address_forms": (address_forms, FORMS_SQL),
    "ipv6_forms": (ipv6_forms, V6_SQL),
    "parsed_texts": (parsed_texts, TEXTS_SQL),
    "json_checks": (json_checks, JSONS_SQL),
    "parsed_readiness": (parsed_readiness, PARSED_SQL),
    "written_findings": (written_findings, planted.READINESS_SQL),
    "kept_versions": (kept_versions, KEPT_SQL),
    "shortened_ids": (shortened_ids, SHORT_SQL),
    "mirrored_addresses": (mirrored_addresses, MIRROR_SQL),
    "reference_problems": (reference_problems, REFERENCE_SQL),
    "block_problems": (block_problems, BLOCK_SQL),
    "plan_differences": (plan_differences, DIFFERENCE_SQL),
    "detected_devices": (detected_devices, DETECTED_SQL),
    "detector_warnings": (detector_warnings, WARNING_SQL),
    "read_texts": (read_texts, READ_SQL),
    "model_detections": (model_detections, MODEL_SQL),
    "box_algebra": (box_algebra, BOX_SQL),
    "segment_geometry": (segment_geometry, SEGMENT_SQL),
}
