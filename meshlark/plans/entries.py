"""Queries over whole entries: raw documents to plans, documents addressed anew, scans and caches in the shared folder, and cable quality."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import ipv6
from ..operators import allocation, entry, kernels, matching, plan, search, validation
from ..sources import cards
from . import answers, planted, values
from .lineage import checkpoint_folder, cut, spread
from .views import dotted


def _folder(spark: SparkSession, *names: str) -> str:
    """A place in the shared folder that these names alone use."""
    top = spark.sparkContext.getCheckpointDir() or checkpoint_folder(spark)
    return f"{top}/scan-{hashlib.md5('|'.join(names).encode()).hexdigest()}"


ODD = ['{"devices":[{"id":"x"}],"links":[],"n":1e999,"m":[1,-1e999]}', '{"a":' + "[" * 66 + "1" + "]" * 66 + "}", "[]", '{"devices":[],"links":[]}']
ODD_FOUND = [[("invalid_json_value", "/n"), ("invalid_json_value", "/m/1")], [("json_nesting_limit", "/a" + "/0" * 64)], [("invalid_architecture", "")], [("missing_devices", "/devices"), ("missing_links", "/links")]]


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arch_id, raw): planted documents as JSON text, and odd ones under ids below 0."""
    odd = spark.read.parquet(f"{sf_dir}/nation.parquet").select((-1 - F.col("n_nationkey")).cast("long").alias("arch_id"), F.element_at(F.array(*[F.lit(x) for x in ODD]), (F.col("n_nationkey") % len(ODD) + 1).cast("int")).alias("raw"))
    return values._raw(*planted.tables(spark, sf_dir)).unionByName(odd)


def raw_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entry.check_raw(raw_documents(spark, sf_dir)).select("arch_id", "code", "path")


RAW_SQL = planted.READINESS_SQL + "".join(f" UNION ALL SELECT -1 - n_nationkey, '{code}', '{path}' FROM nation WHERE n_nationkey % {len(ODD)} = {i}" for i, found in enumerate(ODD_FOUND) for code, path in found)


def planned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw text to plans: only ready documents are hosted, get cards and are planned."""
    out = entry.plan_all(raw_documents(spark, sf_dir), answers.corpus(spark), plan.offers(spark))
    devices = F.json_array_length(F.get_json_object("plan", "$.device_mapping")).cast("long")
    return out.select("arch_id", "ready", "errors", "instance_type", "refused", devices.alias("devices"), F.size("rule_ids").alias("rules"), F.size("limitations").alias("limitations"), "problem")


# Every ready planted document has a router, a switch, two PCs and a server: 1,344 MiB; sixteen required cards and two others.
PLANNED_SQL = f"""
WITH f AS ({RAW_SQL}), n AS (SELECT arch_id, count(*) AS errors FROM f GROUP BY arch_id), a AS (SELECT c_custkey AS arch_id FROM customer UNION ALL SELECT -1 - n_nationkey FROM nation)
SELECT a.arch_id, n.errors IS NULL AS ready, coalesce(n.errors, 0) AS errors, CASE WHEN n.errors IS NULL THEN 't3a.small' END AS instance_type, NULL AS refused, CASE WHEN n.errors IS NULL THEN 5 END AS devices, CASE WHEN n.errors IS NULL THEN 18 END AS rules, CASE WHEN n.errors IS NULL THEN 4 END AS limitations, NULL AS problem
FROM a LEFT JOIN n ON n.arch_id = a.arch_id"""


def readdressed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted documents with a fresh IPv4 plan: blocks of links and devices."""
    devices, links = planted.tables(spark, sf_dir)
    known = cut(validation._known(devices))
    d, k = allocation.readdress(known, validation.valid_links(links, known), "172.16.0.0", 22)
    text = lambda f: F.col("network")[f]["text"]
    one = d.select("arch_id", F.lit("device").alias("kind"), "id", text("ip_address").alias("ip"), F.lit(None).cast("string").alias("other_ip"), text("prefix_length").alias("prefix"), text("subnet_mask").alias("mask"), text("network_address").alias("network"))
    two = k.select("arch_id", F.lit("link").alias("kind"), "id", text("source_ip").alias("ip"), text("target_ip").alias("other_ip"), text("prefix_length").alias("prefix"), text("subnet_mask").alias("mask"), text("network_address").alias("network"))
    return one.unionByName(two)


READDRESS_SQL = (
    planted.VALIDATION.split(",\nfound(")[0]
    + f""",
who AS (SELECT DISTINCT k, no, id FROM (SELECT k, no, source AS id, source = sw AS isw, routed, source_ip AS i4, source_ip6 AS i6 FROM seg UNION ALL SELECT k, no, target, target = sw, routed, target_ip, target_ip6 FROM seg) WHERE NOT coalesce(isw, false) OR routed OR i4 IS NOT NULL OR i6 IS NOT NULL),
need AS (SELECT s.k, s.no, (32 - ceil(log2(greatest(coalesce(h.hosts, 0) + 2, 4))))::INT AS prefix FROM (SELECT DISTINCT k, no FROM seg) s LEFT JOIN hosts h ON h.k = s.k AND h.no = s.no),
block AS (SELECT *, 2886729728 + (sum(1::BIGINT << (32 - prefix)) OVER (PARTITION BY k ORDER BY prefix, no ROWS UNBOUNDED PRECEDING) - (1::BIGINT << (32 - prefix)))::BIGINT AS net FROM need),
given AS MATERIALIZED (SELECT w.k, w.no, w.id, b.net, b.prefix, b.net + row_number() OVER (PARTITION BY w.k, w.no ORDER BY CASE lower(known.type) WHEN 'router' THEN 0 WHEN 'server' THEN 2 WHEN 'switch' THEN 3 ELSE 4 END, known.pos) AS ip FROM who w JOIN block b ON b.k = w.k AND b.no = w.no JOIN known ON known.k = w.k AND known.id = w.id),
mine AS (SELECT g.k, g.id, arg_min(g, seg.pos) AS g FROM given g JOIN seg ON seg.k = g.k AND seg.no = g.no AND g.id IN (seg.source, seg.target) GROUP BY g.k, g.id)
SELECT known.k AS arch_id, 'device' AS kind, known.id, CASE WHEN g IS NOT NULL THEN {dotted("g.ip", "duckdb")} END AS ip, NULL AS other_ip, g.prefix::VARCHAR AS prefix, CASE WHEN g IS NOT NULL THEN {dotted("(4294967296 - (1::BIGINT << (32 - g.prefix)))", "duckdb")} END AS mask, CASE WHEN g IS NOT NULL THEN {dotted("g.net", "duckdb")} END AS network
FROM known LEFT JOIN mine ON mine.k = known.k AND mine.id = known.id
UNION ALL SELECT seg.k, 'link', seg.id, CASE WHEN s.ip IS NOT NULL THEN {dotted("s.ip", "duckdb")} END, CASE WHEN t.ip IS NOT NULL THEN {dotted("t.ip", "duckdb")} END, b.prefix::VARCHAR, {dotted("(4294967296 - (1::BIGINT << (32 - b.prefix)))", "duckdb")}, {dotted("b.net", "duckdb")}
FROM seg JOIN block b ON b.k = seg.k AND b.no = seg.no LEFT JOIN given s ON s.k = seg.k AND s.no = seg.no AND s.id = seg.source LEFT JOIN given t ON t.k = seg.k AND t.no = seg.no AND t.id = seg.target"""
)


# ------------------------------------------------------------------ IPv6 plans
BASE6 = "2001:db8:0:ffff::"


def packed_blocks6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of /64 to /128 for each customer's orders, packed into a /63, which some exceed."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    needs = orders.select(F.col("o_custkey").alias("arch_id"), F.col("o_orderkey").alias("segment_no"), (64 + F.col("o_orderkey") * 7 % 65).cast("int").alias("prefix"))
    out = allocation.vlsm6(needs, "2001:db8:0:fffe::", 63)
    return out.select("arch_id", "segment_no", "prefix", ipv6.hex32(ipv6.parse("network")).alias("network"), "fits")


def _hex(v: str) -> str:
    return f"concat(printf('%016x', (({v}) >> 64::HUGEINT)::UBIGINT), printf('%016x', (({v}) & 18446744073709551615::HUGEINT)::UBIGINT))"


# 2001:db8:0:fffe:: is (0x20010db8 * 2**32 + 0xfffe) * 2**64
PACKED6_SQL = f"""
WITH n AS (SELECT o_custkey AS arch_id, o_orderkey AS segment_no, (64 + o_orderkey * 7 % 65)::INTEGER AS prefix FROM orders),
z AS (SELECT *, 1::HUGEINT << (128 - prefix)::HUGEINT AS size FROM n),
s AS (SELECT *, sum(size) OVER (PARTITION BY arch_id) AS whole, sum(size) OVER (PARTITION BY arch_id ORDER BY prefix, segment_no ROWS UNBOUNDED PRECEDING) - size AS off FROM z)
SELECT arch_id, segment_no, prefix, CASE WHEN whole <= 1::HUGEINT << 65::HUGEINT THEN {_hex("((536939960::HUGEINT * 4294967296 + 65534) << 64::HUGEINT) + off")} END AS network, whole <= 1::HUGEINT << 65::HUGEINT AS fits FROM s"""


def addressed_hosts6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tight IPv6 plan for planted documents out of a /123, which documents of many hosts exceed: the hosts' addresses."""
    devices, links = planted.tables(spark, sf_dir)
    known = cut(validation._known(devices))
    blocks, given = allocation.autoaddress6(known, cut(validation.valid_links(links, known)), BASE6 + "ffe0", 123, None)
    fits = blocks.select("arch_id", "segment", "prefix", "fits")
    return given.join(fits, ["arch_id", "segment"]).select("arch_id", "segment", "device", "prefix", "fits", ipv6.hex32(ipv6.parse("address")).alias("address"))


HOSTS6_SQL = (
    planted.VALIDATION.split(",\nfound(")[0]
    + f""",
{{who}},
need AS (SELECT s.k, s.no, 128 - greatest(2, ceil(log2(coalesce(h.hosts, 0) + 1)))::INT AS prefix FROM (SELECT DISTINCT k, no FROM seg) s LEFT JOIN hosts h ON h.k = s.k AND h.no = s.no),
block AS (SELECT *, sum(1::BIGINT << (128 - prefix)) OVER (PARTITION BY k ORDER BY prefix, no ROWS UNBOUNDED PRECEDING) - (1::BIGINT << (128 - prefix)) AS off, sum(1::BIGINT << (128 - prefix)) OVER (PARTITION BY k) AS whole FROM need)
SELECT w.k AS arch_id, concat('segment_', w.no) AS segment, w.id AS device, b.prefix, b.whole <= 32 AS fits, CASE WHEN b.whole <= 32 THEN {_hex("((536939960::HUGEINT * 4294967296 + 65535) << 64::HUGEINT) + 65504 + (off + row_number() OVER (PARTITION BY w.k, w.no ORDER BY CASE lower(known.type) WHEN 'router' THEN 0 WHEN 'server' THEN 2 WHEN 'switch' THEN 3 ELSE 4 END, known.pos))::HUGEINT")} END AS address
FROM who w JOIN block b ON b.k = w.k AND b.no = w.no JOIN known ON known.k = w.k AND known.id = w.id"""
).replace("{who}", READDRESS_SQL[READDRESS_SQL.index("who AS (") : READDRESS_SQL.index(",\nneed AS")])


# ------------------------------------------------------------------ scans and caches
def hosting_by_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog written to and scanned from the shared folder; the cheapest fitting offer of each document."""
    k = F.col("n_nationkey")
    price = lambda c: F.format_number(c, 4)
    offer = F.struct(F.concat(F.lit("t"), k.cast("string")).alias("instance_type"), (256 * (k + 1)).cast("int").alias("memory_mib"), F.lit(2).alias("vcpus"), price(0.01 + k * 0.002).alias("hourly_compute_usd"))
    path = _folder(spark, sf_dir, "catalog")
    spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.collect_list(offer).alias("offers")).withColumn("max_hourly_compute_usd", F.lit("0.0400")).coalesce(1).write.mode("overwrite").json(path)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("arch_id"), F.lit("pc").alias("type"), F.col("o_orderkey").cast("string").alias("id"))
    out = plan.select_hosting(orders, orders.where("arch_id is null").select("arch_id"), plan.read_offers(spark, path))
    return out.withColumn("hourly_compute_usd", F.col("hourly_compute_usd").cast("double"))


CATALOG_SQL = """
WITH n AS (SELECT o_custkey AS arch_id, count(*) AS devices, (512 + 128 * count(*))::BIGINT AS required_mib FROM orders GROUP BY ALL), o AS (SELECT 256 * (n_nationkey + 1) AS m, concat('t', n_nationkey) AS t, round(0.01 + n_nationkey * 0.002, 4)::DOUBLE AS p FROM nation WHERE n_nationkey <= 15),
b AS (SELECT n.*, (SELECT min({'p': p, 't': t}) FROM o WHERE m >= required_mib) AS o FROM n)
SELECT arch_id, required_mib, CASE WHEN devices <= 16 THEN o.t END AS instance_type, CASE WHEN devices <= 16 THEN o.p END AS hourly_compute_usd, CASE WHEN devices > 16 THEN 'too_large' WHEN o IS NULL THEN 'no_offer' END AS refused FROM b"""


def scanned_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases as JSON lines and as a JSON list, written to and read from the shared folder."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.array(F.lit("R-1"), F.concat(F.lit("R-"), (F.col("o_orderkey") % 9).cast("string"))).alias("required"))
    lines, listed = _folder(spark, sf_dir, "lines") + ".jsonl", _folder(spark, sf_dir, "list") + ".json"
    rows.where("o_orderkey % 2 = 0").write.mode("overwrite").json(lines)
    whole = rows.where("o_orderkey % 2 = 1").groupBy(F.substring("id", -1, 1)).agg(F.to_json(F.collect_list(F.struct("id", "required"))).alias("value"))
    whole.select("value").repartition(8).write.mode("overwrite").option("lineSep", "\n").text(listed)
    schema = "id string, required array<string>"
    found = cards.cases(spark, lines, schema).unionByName(spark.read.text(listed).select(F.explode(F.from_json("value", f"array<struct<{schema.replace(' ', ': ', 1).replace(', required ', ', required: ')}>>")).alias("c")).select("c.*"))
    return found.select("id", F.array_join("required", ",").alias("required"))


CASES_SQL = "SELECT o_orderkey::VARCHAR AS id, concat('R-1,R-', o_orderkey % 9) AS required FROM orders"


def scanned_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files under nested folders of the shared folder; other files are passed over."""
    path = _folder(spark, sf_dir, "cards")
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect():  # 25 rows
        for name, text in ((f"{r['n_nationkey']}.md", f"# {r['n_name']}\nRule-ID: N-{r['n_nationkey']}\n\nbody"), (f"{r['n_nationkey']}.txt", "no card")):
            out = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{r['n_regionkey']}/deep/{name}"), True)
            out.write(bytearray(text.encode()))
            out.close()
    found = cards.files(spark, path)
    rules = cards.records(cards.chunks(found))
    return rules.select(F.regexp_extract("source", "([0-9]+/deep/[^/]+)$", 1).alias("source"), "rule_id", "heading", F.sha2("text", 256).alias("sha256"))


SCAN_SQL = "SELECT concat(n_regionkey, '/deep/', n_nationkey, '.md') AS source, concat('N-', n_nationkey) AS rule_id, concat('# ', n_name) AS heading, sha256(concat('# ', n_name, chr(10), 'Rule-ID: N-', n_nationkey, chr(10), chr(10), 'body')) AS sha256 FROM nation"


def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of cards from a cache whose first version is broken."""
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey").select(F.concat(F.lit("R-"), F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_name").alias("text"))
    folder = _folder(spark, sf_dir, "vectors")
    first = search.cached_vectors(parts, answers.MODELS, folder)
    place = first.inputFiles()[0].rsplit("/", 1)[0]
    broken = spark.createDataFrame([("R-1", [0.0, 0.0])], "rule_id string, vector array<double>")
    broken.write.mode("overwrite").parquet(place)
    again = search.cached_vectors(parts, answers.MODELS, folder)
    return again.select("rule_id", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


VECTOR_SQL = "SELECT concat('R-', p_partkey) AS rule_id, concat_ws(',', 1, " + ", ".join(f"length(p_name) - length(replace(p_name, '{c}', ''))" for c in "aste") + ") AS vector FROM part"


# ------------------------------------------------------------------ boxes and pixels
def items_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that no device's box of their image holds whole."""
    rows, a, b = values._boxes(spark, sf_dir)
    rows = rows.withColumn("image_id", F.floor(F.col("k") / 50))
    return matching.outside_boxes(rows.select("image_id", "k", a.alias("small")), rows.where("k % 3 = 0").select("image_id", G.expand(b, 3.0).alias("box")), "k", "small", 2.0).select("image_id", "k")


OUTSIDE_SQL = f"""
WITH x AS ({values.PAIR}), d AS (SELECT k // 50 AS image_id, bx1 - 3 AS x1, by1 - 3 AS y1, bx2 + 3 AS x2, by2 + 3 AS y2 FROM x WHERE k % 3 = 0)
SELECT k // 50 AS image_id, k FROM x WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.image_id = x.k // 50 AND ax1 >= x1 - 2 AND ay1 >= y1 - 2 AND ax2 <= x2 + 2 AND ay2 <= y2 + 2)"""


def cable_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink under straight cables with gaps, some behind a mask, some with open ends or pruned."""
    k = F.col("p_partkey")
    base = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey").select(k.alias("image_id"))
    i = F.col("image_id")
    paths = base.select("image_id", F.lit(1).alias("path_no"), F.array(G.segment(G.point(F.lit(0), F.lit(20)), G.point(F.lit(99), F.lit(20)))).alias("segments"), (i % 2 == 0).alias("determined"), (i % 7 == 0).cast("int").alias("pruned"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda x: F.when(x % 10 < 10 - (i % 5) * 2, "01").otherwise("00")), "")
    hide = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda x: F.when((i % 3 == 0) & x.between(50, 59), "01").otherwise("00")), "")
    ink = F.unhex(F.concat(F.repeat(F.lit("00"), F.lit(2000)), line, F.repeat(F.lit("00"), F.lit(1900))))
    rasters = base.select("image_id", F.lit(100).alias("width"), F.lit(40).alias("height"), ink.alias("ink"), F.unhex(F.repeat(hide, F.lit(40))).alias("mask"))
    return kernels.score_paths(paths, rasters).select("image_id", "path_no", *[F.round(c, 6).alias(c) for c in ("ink_support", "observed", "confidence")])


QUALITY_SQL = """
WITH s AS (SELECT p_partkey AS k, count(*) AS n, count(*) FILTER (NOT hidden) AS seen, count(*) FILTER (NOT hidden AND x % 10 < 10 - p_partkey % 5 * 2) AS hits FROM (SELECT p_partkey, 3 * i AS x, p_partkey % 3 = 0 AND 3 * i BETWEEN 50 AND 59 AS hidden FROM part CROSS JOIN range(0, 34) AS r(i)) GROUP BY ALL)
SELECT k AS image_id, 1 AS path_no, round(hits / seen, 6) AS ink_support, round(seen / n, 6) AS observed, round((0.4::DOUBLE * hits / seen + 0.2 + 0.2::DOUBLE * seen / n + 0.2::DOUBLE * CASE WHEN k % 2 = 0 THEN 1 ELSE 0.3 END) * CASE WHEN k % 7 = 0 THEN 0.85 ELSE 1 END, 6)::DOUBLE AS confidence FROM s"""

CATALOGUE: dict[str, tuple] = {
    "raw_readiness": (raw_readiness, RAW_SQL),
    "planned_documents": (planned_documents, PLANNED_SQL),
    "readdressed_documents": (readdressed_documents, READDRESS_SQL),
    "packed_blocks6": (packed_blocks6, PACKED6_SQL),
    "addressed_hosts6": (addressed_hosts6, HOSTS6_SQL),
    "hosting_by_catalog": (hosting_by_catalog, CATALOG_SQL),
    "scanned_cases": (scanned_cases, CASES_SQL),
    "scanned_cards": (scanned_cards, SCAN_SQL),
    "cached_vectors": (cached_vectors, VECTOR_SQL),
    "items_outside": (items_outside, OUTSIDE_SQL),
    "cable_quality": (cable_quality, QUALITY_SQL),
}
