"""All queries of the library's own operators, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addr
from ..functions import geometry as G
from ..functions.scores import combine, tier
from ..functions.text import classify
from ..operators import allocation, findings, graph, matching, plan, readiness, search, validation
from . import answers, entries, planted, scenes, values, views
from .views import with_more, with_views

# ------------------------------------------------------------------ DuckDB text
INT = "(split_part({0}, '.', 1)::BIGINT * 16777216 + split_part({0}, '.', 2)::BIGINT * 65536 + split_part({0}, '.', 3)::BIGINT * 256 + split_part({0}, '.', 4)::BIGINT)"


def _int(c: str) -> str:
    return INT.format(c)


def _ip(v: str) -> str:
    return views.dotted(v, "duckdb")


FINDINGS_SQL = f"""
known AS (SELECT *, {_int("ip")} AS i, {_int("base")} AS b FROM devices),
ends AS (SELECT arch_id, pos, 'source' AS side, source AS id, source_ip AS ip, base, prefix FROM links UNION ALL SELECT arch_id, pos, 'target', target, target_ip, base, prefix FROM links),
used AS (SELECT arch_id, id, list(DISTINCT ip) AS ips FROM ends WHERE ip IS NOT NULL GROUP BY ALL),
n AS (SELECT arch_id, id, count(*) AS n FROM ends GROUP BY ALL),
f AS (
SELECT arch_id, 'network_address_mismatch' AS code, concat('/devices/', pos, '/network/network_address') AS path, concat('network_address should be ', {_ip("(i // 65536 * 65536)")}, ' for ', ip, '/', prefix, '.') AS message FROM known WHERE b <> i // 65536 * 65536
UNION ALL SELECT arch_id, 'subnet_mask_mismatch', concat('/devices/', pos, '/network/subnet_mask'), 'subnet_mask does not match prefix_length /16.' FROM known WHERE mask <> '255.255.0.0'
UNION ALL SELECT arch_id, 'link_ip_outside_network', concat('/links/', pos, '/network/', side, '_ip'), concat('''', id, '''''s address on this link is not inside the link''s network.') FROM ends WHERE {_int("ip")} // 65536 * 65536 <> {_int("base")}
UNION ALL SELECT d.arch_id, 'isolated_device', concat('/devices/', pos), concat('Device ''', d.id, ''' has no valid link to another device.') FROM known d ANTI JOIN n ON n.arch_id = d.arch_id AND n.id = d.id
UNION ALL SELECT d.arch_id, 'too_many_links', concat('/devices/', pos), concat('Device ''', d.id, ''' is a pc; a pc may have only one link.') FROM known d JOIN n ON n.arch_id = d.arch_id AND n.id = d.id WHERE type = 'pc' AND n.n > 1
UNION ALL SELECT d.arch_id, 'device_ip_not_on_link', concat('/devices/', pos, '/network/ip_address'), concat('Device ''', d.id, '''''s ip_address is not the address it uses on any link.') FROM known d JOIN used u ON u.arch_id = d.arch_id AND u.id = d.id WHERE d.ip IS NOT NULL AND NOT list_contains(ips, d.ip))
"""


def readiness_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    return readiness.check(devices, links).select("arch_id", "code", "path", "message")


def readiness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    return findings.counts(readiness.check(devices, links)).drop("severity")


def isolated_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    ends = readiness.valid_ends(readiness.endpoints(links, devices))
    return devices.select("arch_id", "id").join(ends.select("arch_id", F.col("device_id").alias("id")), ["arch_id", "id"], "left_anti")


def ipv4_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _ = views.plain(spark, sf_dir)
    i, p = addr.ip_to_int(F.col("ip")), F.col("prefix")
    return d.where("ip is not null").select(
        "arch_id", "id", i.alias("ip_int"), addr.int_to_ip(i).alias("ip_text"), addr.mask_to_prefix(F.col("mask")).alias("mask_prefix"), addr.prefix_to_mask(p).alias("prefix_mask"),
        addr.int_to_ip(addr.network_of(i, p)).alias("network"), addr.int_to_ip(addr.broadcast_of(i, p)).alias("broadcast"), addr.ip_in_network(i, addr.ip_to_int(F.col("base")), p).alias("inside"),
        addr.usable_hosts(p).alias("usable"), addr.is_network_form(i, p).alias("network_form"),
    )


IPV4_SQL = with_views(f"""
SELECT arch_id, id, i AS ip_int, {_ip("i")} AS ip_text, bit_count({_int("mask")})::INTEGER AS mask_prefix, '255.255.0.0' AS prefix_mask, {_ip("(i // 65536 * 65536)")} AS network,
 {_ip("(i // 65536 * 65536 + 65535)")} AS broadcast, i // 65536 * 65536 = {_int("base")} AS inside, 65534::BIGINT AS usable, i % 65536 = 0 AS network_form
FROM (SELECT *, {_int("ip")} AS i FROM devices WHERE ip IS NOT NULL)""")


def host_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    i = F.pmod(F.col("o_orderkey") * F.lit(2654435761), F.lit(1 << 32))
    p = F.pmod(F.col("o_orderkey"), F.lit(33)).cast("int")
    bad = addr.host_problem(i, p)
    return orders.select("o_orderkey", addr.int_to_ip(i).alias("ip"), p.alias("prefix"), bad["code"].alias("code"), bad["severity"].alias("severity"))


HOSTS_SQL = f"""
WITH x AS (SELECT o_orderkey, (o_orderkey::HUGEINT * 2654435761 % 4294967296)::BIGINT AS i, (o_orderkey % 33)::INTEGER AS p FROM orders),
y AS (SELECT *, (1::BIGINT << (32 - p)) AS size, (4294967295 - i) AS rest FROM x),
z AS (SELECT *, CASE WHEN rest & (rest + 1) = 0 AND bit_count(i) >= 8 THEN 'ip_looks_like_mask' WHEN i < 16777216 OR i >> 24 = 127 OR i >> 28 IN (14, 15) THEN 'reserved_ip'
 WHEN p <= 30 AND i % size = 0 THEN 'ip_is_network_address' WHEN p <= 30 AND i % size = size - 1 THEN 'ip_is_broadcast_address' WHEN i >> 16 = 43518 THEN 'link_local_ip' END AS code FROM y)
SELECT o_orderkey, {_ip("i")} AS ip, p AS prefix, code, CASE WHEN code = 'link_local_ip' THEN 'warning' WHEN code IS NOT NULL THEN 'error' END AS severity FROM z"""


def host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    k = F.col("p_partkey")
    network = F.concat(F.lit("10.0."), F.pmod(k, F.lit(256)).cast("string"), F.lit("."), (F.pmod(k, F.lit(5)) * 64).cast("string"))
    p = (F.pmod(k, F.lit(12)) + 21).cast("int")
    suffix = F.concat(F.lit("."), F.pmod(k * 7, F.lit(300)).cast("string"))
    rows = part.select("p_partkey", network.alias("network"), p.alias("prefix"), suffix.alias("suffix"))
    return rows.withColumn("got", addr.resolve_host_suffix(F.col("network"), F.col("prefix"), F.col("suffix"))).select("p_partkey", "network", "prefix", "suffix", "got.address", "got.reason")


SUFFIX_SQL = f"""
WITH x AS (SELECT p_partkey, p_partkey % 256 AS o3, p_partkey % 5 * 64 AS o4, (p_partkey % 12 + 21)::INTEGER AS p, p_partkey * 7 % 300 AS s FROM part),
y AS (SELECT *, 167772160::BIGINT + o3 * 256 + o4 AS base, 167772160::BIGINT + o3 * 256 + s AS cand, (1::BIGINT << (32 - p)) AS size FROM x),
z AS (SELECT *, CASE WHEN s > 255 THEN 'invalid_host_suffix' WHEN o4 > 255 THEN 'invalid_network' WHEN p NOT BETWEEN 24 AND 31 THEN 'prefix_outside_final_octet_range' WHEN base % size <> 0 THEN 'network_address_has_host_bits'
 WHEN cand // size * size <> base THEN 'suffix_outside_network' WHEN p <= 30 AND (cand = base OR cand = base + size - 1) THEN 'suffix_is_network_or_broadcast_address' ELSE 'resolved' END AS reason FROM y)
SELECT p_partkey, concat('10.0.', o3, '.', o4) AS network, p AS prefix, concat('.', s) AS suffix, CASE WHEN reason = 'resolved' THEN {_ip("cand")} END AS address, reason FROM z"""

# Literal labels and their classes, for the classifier's check.
LABELS = [
    ("10.0.0.1", "ipv4"), ("10.0.0.1/24", "ipv4_cidr"), ("255.255.255.0", "subnet_mask"), ("0.0.0.0", "unknown"), (".10", "host_suffix"), (".256", "unknown"), ("::2", "host_suffix"), ("2001:db8::1", "ipv6"),
    ("2001:db8::1/64", "ipv6_cidr"), ("2001:db8::1/129", "unknown"), ("R1", "device_name"), ("SW-2", "device_name"), ("Server10", "device_name"), ("Gi0/1", "unknown"), ("Fa0", "unknown"), ("ethernet", "unknown"), ("Trunk", "unknown"),
    ("10.0.0.01", "unknown"), ("10.0.0.1/33", "unknown"), ("256.1.1.1", "unknown"), ("hello world", "unknown"), ("Vlan10", "unknown"), ("PC_12", "device_name"), ("255.0.255.0", "ipv4"),
]


def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    labels = spark.createDataFrame([(t,) for t, _ in LABELS], "label string")
    return nation.crossJoin(F.broadcast(labels)).select("n_nationkey", "label", classify(F.col("label")).alias("class"))  # literal labels


LABELS_SQL = "SELECT n_nationkey, label, class FROM nation CROSS JOIN (VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in LABELS) + ") AS x(label, class)"


def device_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    return graph.device_components(devices, links).select("arch_id", F.col("v").alias("id"), "root")


# A label spreads from each nation and region only, which every path between other devices meets.
COMPONENTS_SQL = with_more(
    """hub AS MATERIALIZED (SELECT arch_id, id FROM devices WHERE type IN ('router', 'switch')),
e AS MATERIALIZED (SELECT l.arch_id, source AS a, target AS b FROM links l WHERE l.source LIKE 'r%' UNION SELECT arch_id, target, source FROM links WHERE source LIKE 'r%'),
reach AS (SELECT arch_id, id, id AS other FROM hub UNION SELECT reach.arch_id, reach.id, e.b FROM reach JOIN e ON e.arch_id = reach.arch_id AND e.a = reach.other),
leaf AS MATERIALIZED (SELECT arch_id, source AS id, target AS other FROM links WHERE source NOT LIKE 'r%'),
least AS MATERIALIZED (SELECT r.arch_id, r.id, least(min(r.other), min(l.id)) AS root FROM reach r LEFT JOIN leaf l ON l.arch_id = r.arch_id AND l.other = r.other GROUP BY ALL)""",
    """SELECT arch_id, id, root FROM least
UNION ALL SELECT d.arch_id, d.id, coalesce(min(least.root), d.id) FROM devices d LEFT JOIN leaf ON leaf.arch_id = d.arch_id AND leaf.id = d.id LEFT JOIN least ON least.arch_id = d.arch_id AND least.id = leaf.other
WHERE d.type NOT IN ('router', 'switch') GROUP BY d.arch_id, d.id""",
)


def broadcast_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    seg_links, seg_devices = graph.segments(devices, links)
    n = seg_links.groupBy("arch_id", "segment").agg(F.count(F.lit(1)).alias("n_links"), F.min("pos").alias("first_link"))
    h = seg_devices.groupBy("arch_id", "segment").agg(F.count_if("is_host").alias("n_hosts"), F.count_if("is_bridge").alias("n_bridges"))
    return n.join(h, ["arch_id", "segment"])


# Every link ends at one nation's switch, so a nation is a segment.
SEGMENTS_SQL = with_views("""
SELECT arch_id, concat('segment_', row_number() OVER (PARTITION BY arch_id ORDER BY first_link)) AS segment, n_links, first_link, n_hosts, n_bridges FROM (
 SELECT arch_id, target, count(*) AS n_links, min(pos) AS first_link, count(DISTINCT source) AS n_hosts, 1::BIGINT AS n_bridges FROM links GROUP BY arch_id, target)""")


def switch_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches joined in a ring by nation keys, in every other region."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    devices = nation.select(F.col("n_regionkey").alias("arch_id"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("switch").alias("type"))
    ring = nation.alias("a").join(nation.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and b.n_nationkey > a.n_nationkey and (a.n_regionkey % 2 = 0 or b.n_nationkey - a.n_nationkey < 4)"))
    links = ring.select(F.col("a.n_regionkey").alias("arch_id"), F.concat(F.lit("n"), F.col("a.n_nationkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("b.n_nationkey").cast("string")).alias("target"))
    return graph.switch_cycles(devices, links)


CYCLES_SQL = """
WITH RECURSIVE e AS (SELECT a.n_regionkey AS r, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey
 AND (a.n_regionkey % 2 = 0 OR b.n_nationkey - a.n_nationkey < 4)),
ways AS (SELECT r, a, b FROM e UNION SELECT r, b, a FROM e),
reach AS (SELECT n_regionkey AS r, n_nationkey AS v, n_nationkey AS w FROM nation UNION SELECT ways.r, reach.v, ways.b FROM reach JOIN ways ON ways.r = reach.r AND ways.a = reach.w),
c AS (SELECT r, count(DISTINCT root) AS c FROM (SELECT r, v, min(w) AS root FROM reach GROUP BY r, v) GROUP BY r),
n AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1), m AS (SELECT r, count(*) AS m FROM e GROUP BY r)
SELECT n.r AS arch_id, coalesce(m, 0) > n.n - c.c AS has_cycle FROM n JOIN c USING (r) LEFT JOIN m USING (r)"""


def vlsm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    _, seg_devices = graph.segments(devices, links)
    blocks = allocation.vlsm(allocation.segment_needs(seg_devices), 10 << 24, 8)
    return blocks.select("arch_id", "segment", "hosts", "prefix", addr.int_to_ip(F.col("network")).alias("network"), "fits")


VLSM_SQL = with_views(f"""
SELECT arch_id, segment, hosts, prefix, {_ip("(167772160 + coalesce(before, 0)::BIGINT)")} AS network, true AS fits FROM (
 SELECT *, sum(1::BIGINT << (32 - prefix)) OVER (PARTITION BY arch_id ORDER BY prefix, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
  SELECT arch_id, no, concat('segment_', no) AS segment, hosts, (SELECT max(p) FROM range(0, 31) AS t(p) WHERE (1::BIGINT << (32 - p)) - 2 >= hosts)::INTEGER AS prefix FROM (
   SELECT arch_id, row_number() OVER (PARTITION BY arch_id ORDER BY min(pos)) AS no, count(DISTINCT source) AS hosts FROM links GROUP BY arch_id, target)))""")


def autoaddress_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    _, given = allocation.autoaddress(devices, links, "10.0.0.0", 8)
    return given


AUTO_SQL = with_views(f"""
SELECT arch_id, segment, device, {_ip("(network + n)")} AS address FROM (
 SELECT s.arch_id, segment, network, l.source AS device, row_number() OVER (PARTITION BY s.arch_id, segment ORDER BY CASE d.type WHEN 'router' THEN 0 WHEN 'server' THEN 2 ELSE 4 END, d.pos) AS n FROM (
  SELECT arch_id, target, concat('segment_', no) AS segment, 167772160 + coalesce(sum(1::BIGINT << (32 - prefix)) OVER (PARTITION BY arch_id ORDER BY prefix, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS network FROM (
   SELECT *, (SELECT max(p) FROM range(0, 31) AS t(p) WHERE (1::BIGINT << (32 - p)) - 2 >= hosts)::INTEGER AS prefix FROM (
    SELECT arch_id, target, row_number() OVER (PARTITION BY arch_id ORDER BY min(pos)) AS no, count(DISTINCT source) AS hosts FROM links GROUP BY arch_id, target))) s
 JOIN links l ON l.arch_id = s.arch_id AND l.target = s.target JOIN devices d ON d.arch_id = l.arch_id AND d.id = l.source)""")


def duplicate_lan_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    return graph.duplicate_lan_addresses(devices, links).select("arch_id", "pos", "side", "value", "device", "owner")


LAN_SQL = with_views("""
SELECT arch_id, pos, 'source' AS side, source_ip AS value, source AS device, owner FROM (
 SELECT *, first_value(source) OVER (PARTITION BY arch_id, target, source_ip ORDER BY pos) AS owner FROM links) WHERE source <> owner""")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated set of queries: benchmark items whose id is divisible by 20."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = search.bm25(docs, _queries(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return search.top_k(scores, 10)


BM25 = """
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 20 = 0),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
t AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
b AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score FROM q JOIN t USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY query_id, doc_id)"""
BM25_SQL = f"WITH {BM25}\nSELECT query_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 10"


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.dense_top_k(vectors, asked, 10).withColumn("score", F.round("score", 6))


DENSE_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 12) AS score FROM v q CROSS JOIN v WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's ranking fused with the same scores' ranking by documents' length-normalised order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = search.bm25(docs, _queries(spark, sf_dir)).withColumn("score", F.round("score", 6))
    first = search.top_k(scores, 50)
    second = search.top_k(scores.withColumn("score", F.round(F.col("score") / (F.col("doc_id") + 1), 9)), 50)
    fused = search.fuse([first, second]).withColumn("score", F.round("score", 9))
    return search.top_k(fused, 10)


RRF_SQL = f"""WITH {BM25},
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b UNION ALL
 SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score / (doc_id + 1), 9) DESC, doc_id) FROM b),
u AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM r WHERE rank <= 50 GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u) WHERE rank <= 10"""


def required_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    return search.pinned_rules(graph.facts(devices, links)).select("arch_id", "ord", "rule_id")


RULES_SQL = with_views(f"""
SELECT arch_id, (row_number() OVER (PARTITION BY arch_id ORDER BY o) - 1)::INTEGER AS ord, rule_id FROM (
 SELECT arch_id, o, rule_id FROM (SELECT DISTINCT arch_id FROM devices) CROSS JOIN (SELECT unnest(range(0, 16)) AS o, unnest({[*search.ALWAYS, "L2-001", "L2-003", "ROUTE-001", "EX-LAN"]}) AS rule_id)
 UNION ALL SELECT DISTINCT arch_id, 20, 'EX-STANDALONE' FROM devices d ANTI JOIN (SELECT arch_id, source AS id FROM links UNION SELECT arch_id, target FROM links) l USING (arch_id, id)
 UNION ALL SELECT arch_id, 21, 'EX-ISOLATED' FROM (SELECT arch_id FROM devices d ANTI JOIN (SELECT arch_id, source AS id FROM links UNION SELECT arch_id, target FROM links) l USING (arch_id, id)
  UNION SELECT arch_id FROM devices WHERE type = 'switch' AND (pos - 1) % 7 = 0))""")

# ------------------------------------------------------------------ spatial
BOXES = """SELECT {cast} AS image_id, p_partkey AS id, p_partkey % 97 * 9.0 AS x1, p_partkey * 31 % 23 * 7.0 AS y1, p_partkey % 97 * 9.0 + 20 + p_size AS x2, p_partkey * 31 % 23 * 7.0 + 12 + p_size % 7 AS y2,
 0.5 + p_partkey % 50 / 100.0 AS conf, p_partkey % 3 = 0 AS is_device FROM part"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    x, y = F.pmod(k, F.lit(97)) * F.lit(9.0), F.pmod(k * 31, F.lit(23)) * F.lit(7.0)
    box = G.rect(x, y, x + 20 + s, y + 12 + F.pmod(s, F.lit(7)))
    return part.select(F.floor(k / 100).alias("image_id"), k.alias("id"), box.alias("box"), (F.lit(0.5) + F.pmod(k, F.lit(50)) / F.lit(100.0)).alias("confidence"), (F.pmod(k, F.lit(3)) == 0).alias("is_device"))


BOX_CTE = "x AS MATERIALIZED (" + BOXES.format(cast="p_partkey // 100") + ")"
GAP = "sqrt(greatest(0.0, {b}.x1 - {a}.x2, {a}.x1 - {b}.x2)**2 + greatest(0.0, {b}.y1 - {a}.y2, {a}.y1 - {b}.y2)**2)"


def text_device_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    texts = boxes.where("not is_device").select("image_id", F.col("id").alias("text_id"), "box", "confidence")
    devices = boxes.where("is_device").select("image_id", F.col("id").alias("device_id"), "box", "confidence")
    out = matching.match_texts(texts, devices, matching.ADDRESS_GAP)
    return out.select("image_id", "text_id", "status", "winner", "best", F.round("best_score", 6).alias("best_score"), "runner_up", F.round("runner_up_score", 6).alias("runner_up_score"))


DECIDE_SQL = f"""
WITH {BOX_CTE},
p AS (SELECT t.image_id, t.id AS text_id, d.id AS device_id, greatest(d.x2 - d.x1, d.y2 - d.y1, 1.0) AS size, {GAP.format(a="t", b="d")} AS gap, (t.x1 + t.x2) / 2 AS tx, (t.y1 + t.y2) / 2 AS ty, (d.x1 + d.x2) / 2 AS dx, (d.y1 + d.y2) / 2 AS dy,
 greatest(0.0, d.x1 - t.x2, t.x1 - d.x2) AS sx, greatest(0.0, d.y1 - t.y2, t.y1 - d.y2) AS sy, d.x2 - d.x1 AS dw, t.x2 - t.x1 AS tw, d.y2 - d.y1 AS dh, t.y2 - t.y1 AS th, t.conf AS ocr, d.conf AS yolo
 FROM x t JOIN x d ON t.image_id = d.image_id AND NOT t.is_device AND d.is_device),
l AS (SELECT *, CASE WHEN sx = 0 AND sy = 0 THEN 'inside' WHEN sx > 0 AND sy > 0 THEN 'diagonal' WHEN sy > 0 AND ty > dy THEN 'below' WHEN sy > 0 THEN 'above' WHEN tx > dx THEN 'right' ELSE 'left' END AS loc FROM p WHERE gap <= 0.9 * size),
s AS (SELECT image_id, text_id, device_id, least(1.0, greatest(0.0, 0.35 * (1 - gap / (0.9 * size)) + 0.10 * least(1, greatest(0, 1 - sqrt((tx - dx)**2 + (ty - dy)**2) / (2 * size)))
 + 0.10 * CASE loc WHEN 'below' THEN 1.0 WHEN 'above' THEN 0.9 WHEN 'inside' THEN 0.7 WHEN 'diagonal' THEN 0.6 ELSE 0.85 END
 + 0.20 * CASE WHEN loc IN ('above', 'below', 'inside') THEN least(1, greatest(0, 1 - abs(tx - dx) / (dw / 2 + tw / 2))) WHEN loc IN ('left', 'right') THEN least(1, greatest(0, 1 - abs(ty - dy) / (dh / 2 + th / 2))) ELSE 0 END
 + 0.15 * ocr + 0.10 * yolo)) AS score FROM l),
r AS (SELECT *, row_number() OVER w AS rn, lead(device_id) OVER w AS ru, lead(score) OVER w AS rs FROM s WHERE score > 0 WINDOW w AS (PARTITION BY image_id, text_id ORDER BY score DESC, device_id::VARCHAR)),
c AS (SELECT t.image_id, t.id AS text_id, CASE WHEN score IS NULL THEN 'no_candidates' WHEN score < 0.55 THEN 'unresolved' WHEN rs >= 0.55 AND score - rs < 0.08 THEN 'ambiguous' WHEN score >= 0.75 THEN 'accepted' ELSE 'flagged' END AS status,
 device_id, score, ru, rs FROM x t LEFT JOIN r ON r.image_id = t.image_id AND r.text_id = t.id AND rn = 1 WHERE NOT t.is_device)
SELECT image_id, text_id, status, CASE WHEN status IN ('accepted', 'flagged') THEN device_id END AS winner, device_id AS best, round(score, 6) AS best_score, ru AS runner_up, round(rs, 6) AS runner_up_score FROM c"""


def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir).withColumn("device_id", F.col("id"))
    return matching.duplicate_boxes(boxes, 0.1).withColumn("iou", F.round("iou", 6))


IOU_SQL = f"""
WITH {BOX_CTE},
p AS (SELECT a.image_id, a.id AS kept, b.id AS dropped, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
 FROM x a JOIN x b ON a.image_id = b.image_id AND (a.conf > b.conf OR a.conf = b.conf AND a.id < b.id))
SELECT image_id, kept, dropped, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.1"""


def segment_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    k = F.col("id")
    seg = G.segment(G.point(F.pmod(k * 13, F.lit(900)), F.pmod(k * 17, F.lit(640))), G.point(F.pmod(k * 19, F.lit(900)), F.pmod(k * 23, F.lit(640))))
    near = boxes.withColumn("seg", seg)
    c = G.center(F.col("box"))
    return near.select(
        "id", F.round(G.seg_length(F.col("seg")), 6).alias("length"), F.round(G.point_seg_distance(c, F.col("seg")), 6).alias("center_distance"), F.round(G.point_line_distance(c, F.col("seg")), 6).alias("line_distance"),
        F.round(G.project_param(c, F.col("seg")), 6).alias("param"), F.round(G.point_distance(F.col("box"), F.col("seg")["p1"]), 6).alias("start_distance"), tier(F.col("confidence")).alias("tier"), F.round(combine(F.col("confidence"), F.lit(0.8), F.lit(None).cast("double")), 6).alias("combined"),
    )


DISTANCE_SQL = f"""
WITH {BOX_CTE},
g AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (id * 13 % 900)::DOUBLE AS ax, (id * 17 % 640)::DOUBLE AS ay, (id * 19 % 900)::DOUBLE AS bx, (id * 23 % 640)::DOUBLE AS by_ FROM x),
v AS (SELECT *, bx - ax AS vx, by_ - ay AS vy, (bx - ax)**2 + (by_ - ay)**2 AS l2 FROM g),
t AS (SELECT *, CASE WHEN l2 < 1e-9 THEN 0 ELSE ((cx - ax) * vx + (cy - ay) * vy) / l2 END AS t FROM v)
SELECT id, round(sqrt(l2), 6) AS length, round(sqrt((cx - (ax + least(1, greatest(0, t)) * vx))**2 + (cy - (ay + least(1, greatest(0, t)) * vy))**2), 6) AS center_distance,
 round(CASE WHEN sqrt(l2) < 1e-9 THEN sqrt((cx - ax)**2 + (cy - ay)**2) ELSE abs((cx - ax) * vy - (cy - ay) * vx) / sqrt(l2) END, 6) AS line_distance, round(t, 6) AS param,
 round(sqrt(greatest(x1 - ax, 0, ax - x2)**2 + greatest(y1 - ay, 0, ay - y2)**2), 6) AS start_distance, CASE WHEN conf >= 0.75 THEN 'accepted' WHEN conf >= 0.55 THEN 'flagged' ELSE 'unresolved' END AS tier,
 round(exp((ln(conf) + ln(0.8::DOUBLE)) / 2), 6) AS combined FROM t"""


def reading_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _boxes(spark, sf_dir).groupBy("image_id").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), "box")).alias("items"))
    return items.select("image_id", F.posexplode(G.reading_order(F.col("items"))).alias("place", "id"))


# A row's first item anchors it; items further than the band open the next row.
ORDER_SQL = f"""
WITH RECURSIVE {BOX_CTE},
o AS (SELECT image_id::BIGINT AS image_id, id::VARCHAR AS id, (y1 + y2) / 2 AS cy, (x1 + x2) / 2 AS cx, y2 - y1 AS h FROM x),
b AS (SELECT image_id, greatest(8.0, 0.5 * list_extract(list(h ORDER BY h), (count(*) // 2 + 1)::INT)) AS band FROM o GROUP BY image_id),
r AS MATERIALIZED (SELECT o.*, band, row_number() OVER (PARTITION BY image_id ORDER BY cy, cx, id) AS rn FROM o JOIN b USING (image_id)),
s AS (SELECT image_id, id, cx, rn, cy AS anchor, 1 AS line FROM r WHERE rn = 1
 UNION ALL SELECT r.image_id, r.id, r.cx, r.rn, CASE WHEN abs(r.cy - s.anchor) > band THEN r.cy ELSE s.anchor END, CASE WHEN abs(r.cy - s.anchor) > band THEN s.line + 1 ELSE s.line END FROM s JOIN r ON r.image_id = s.image_id AND r.rn = s.rn + 1)
SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY line, cx, id) - 1)::INT AS place, id FROM s"""


def plan_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    return plan.plan_endpoints(devices, links)


ENDPOINT_SQL = with_views("""
SELECT l.arch_id, l.pos, l.id AS link_id, side, d.id AS device_id, concat('n', substr(sha256(d.id), 1, 12)) AS runtime_ref, concat(CASE side WHEN 'source' THEN 'va' ELSE 'vb' END, substr(sha256(l.id), 1, 12)) AS interface_id, e.ip AS ip_address,
 CASE WHEN e.ip IS NULL THEN NULL WHEN e.ip = d.ip THEN d.prefix ELSE l.prefix END AS prefix_length
FROM links l CROSS JOIN LATERAL (SELECT unnest(['source', 'target']) AS side, unnest([l.source, l.target]) AS id, unnest([l.source_ip, l.target_ip]) AS ip) e JOIN devices d ON d.arch_id = l.arch_id AND d.id = e.id""")


def configuration_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    return plan.configuration_targets(devices, links).select("arch_id", "device_id", "runtime_ref", F.array_join("interface_refs", ",").alias("interface_refs"))


TARGETS_SQL = with_views("""
SELECT d.arch_id, d.id AS device_id, concat('n', substr(sha256(d.id), 1, 12)) AS runtime_ref, coalesce(string_agg(CASE WHEN l.id IS NOT NULL THEN concat(CASE WHEN l.source = d.id THEN 'va' ELSE 'vb' END, substr(sha256(l.id), 1, 12)) END, ',' ORDER BY l.pos), '') AS interface_refs
FROM devices d LEFT JOIN links l ON l.arch_id = d.arch_id AND (l.source = d.id OR l.target = d.id) GROUP BY ALL""")


def hosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each customer's orders: roles by order priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("pc", "server", "router", "switch", "hub")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    devices = orders.select(F.col("o_custkey").alias("arch_id"), F.col("o_orderkey").cast("string").alias("id"), kind.alias("type"))
    links = orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("arch_id"))
    return plan.select_hosting(devices, links, plan.offers(spark)).withColumn("hourly_compute_usd", F.col("hourly_compute_usd").cast("double"))


HOSTING_SQL = f"""
WITH d AS (SELECT o_custkey AS arch_id, ['pc', 'server', 'router', 'switch', 'hub'][substr(o_orderpriority, 1, 1)::INTEGER] AS type, o_orderkey FROM orders),
n AS (SELECT arch_id, count(*) AS devices, count(*) FILTER (o_orderkey % 2 = 0) AS links, count(*) FILTER (type = 'hub') AS bad, (512 + sum(CASE type WHEN 'pc' THEN 128 WHEN 'server' THEN 256 WHEN 'router' THEN 256 WHEN 'switch' THEN 64 ELSE 0 END))::BIGINT AS required_mib FROM d GROUP BY arch_id),
o(t, m, p) AS (VALUES {", ".join(f"('{t}', {m}, {p})" for t, m, _, p in plan.OFFERS)}),
b AS (SELECT n.*, (SELECT min((p, t)) FROM o WHERE m >= required_mib AND p <= 0.04) AS o FROM n)
SELECT arch_id, required_mib, CASE WHEN bad = 0 AND devices <= 16 AND links <= 24 THEN o[2] END AS instance_type, CASE WHEN bad = 0 AND devices <= 16 AND links <= 24 THEN o[1]::DOUBLE END AS hourly_compute_usd,
 CASE WHEN bad > 0 THEN 'unsupported_type' WHEN devices > 16 OR links > 24 THEN 'too_large' WHEN o IS NULL THEN 'no_offer' END AS refused FROM b"""


def device_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    return graph.neighbours(devices, links)


NEIGHBOURS_SQL = with_views("SELECT arch_id, source AS id, target AS other FROM links UNION SELECT arch_id, target, source FROM links")


def duplicate_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every device address that another device of the document has too."""
    d, _ = views.plain(spark, sf_dir)
    path = F.concat(F.lit("/devices/"), F.col("pos").cast("string"), F.lit("/network/ip_address"))
    uses = d.where("ip is not null").select("arch_id", F.lit(4).alias("fam"), "ip", "id", "pos", path.alias("path"))
    return validation.duplicate_addresses(uses).select("arch_id", "path", "subject", "value", F.array_join("related", ",").alias("related"))


DUPLICATE_SQL = with_views("""
SELECT d.arch_id, concat('/devices/', d.pos, '/network/ip_address') AS path, d.id AS subject, d.ip AS value, string_agg(o.id, ',' ORDER BY o.id) AS related
FROM devices d JOIN devices o ON o.arch_id = d.arch_id AND o.ip = d.ip AND o.id <> d.id GROUP BY ALL""")


def name_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders claim their customer by a score: the best keeps it, unless the second is close."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.pmod("o_custkey", F.lit(7)).alias("image_id"), "o_custkey", "o_orderkey", (F.pmod(F.col("o_orderkey") * 37, F.lit(101)) / 100.0).alias("score"))
    return matching.claims(rows, "o_custkey", "o_orderkey", "score")


CLAIMS_SQL = """
WITH x AS (SELECT o_custkey % 7 AS image_id, o_custkey, o_orderkey, (o_orderkey * 37 % 101) / 100.0::DOUBLE AS score FROM orders),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM x WINDOW w AS (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey)),
t AS (SELECT *, max(CASE WHEN rn = 1 AND second IS NOT NULL AND score - second < 0.08 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS tie FROM r)
SELECT image_id, o_custkey, o_orderkey, score, CASE WHEN tie = 1 THEN 'tied' WHEN rn = 1 THEN 'kept' ELSE 'lost' END AS claim FROM t"""


def pinned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = views.documents(spark, sf_dir)
    return search.feature_queries(graph.facts(devices, links)).select("arch_id", F.array_join("queries", "; ").alias("queries"))


FEATURES_SQL = with_views("""
SELECT DISTINCT arch_id, 'device mapping pc router server switch; switch chain bridge STP loop switching paths; same switch same VLAN local ping ARP' AS queries FROM devices""")

CATALOGUE: dict[str, tuple] = {
    "readiness_report": (readiness_report, with_more(FINDINGS_SQL.strip(), "SELECT arch_id, code, count(*) AS n FROM f GROUP BY ALL")),
    "readiness_findings": (readiness_findings, with_more(FINDINGS_SQL.strip(), "SELECT arch_id, code, path, message FROM f")),
    "isolated_devices": (isolated_devices, with_views("SELECT arch_id, id FROM devices d ANTI JOIN (SELECT arch_id, source AS id FROM links UNION SELECT arch_id, target FROM links) l USING (arch_id, id)")),
    "ipv4_algebra": (ipv4_algebra, IPV4_SQL),
    "host_problems": (host_problems, HOSTS_SQL),
    "host_suffixes": (host_suffixes, SUFFIX_SQL),
    "label_classes": (label_classes, LABELS_SQL),
    "device_components": (device_components, COMPONENTS_SQL),
    "broadcast_segments": (broadcast_segments, SEGMENTS_SQL),
    "switch_cycles": (switch_cycles, CYCLES_SQL),
    "vlsm_blocks": (vlsm_blocks, VLSM_SQL),
    "autoaddress_hosts": (autoaddress_hosts, AUTO_SQL),
    "duplicate_lan_addresses": (duplicate_lan_addresses, LAN_SQL),
    "device_neighbours": (device_neighbours, NEIGHBOURS_SQL),
    "duplicate_ips": (duplicate_ips, DUPLICATE_SQL),
    "name_claims": (name_claims, CLAIMS_SQL),
    "pinned_features": (pinned_features, FEATURES_SQL),
    "bm25_topk": (bm25_topk, BM25_SQL),
    "dense_topk": (dense_topk, DENSE_SQL),
    "rank_fusion": (rank_fusion, RRF_SQL),
    "required_rules": (required_rules, RULES_SQL),
    "text_device_decisions": (text_device_decisions, DECIDE_SQL),
    "overlapping_boxes": (overlapping_boxes, IOU_SQL),
    "segment_distances": (segment_distances, DISTANCE_SQL),
    "reading_orders": (reading_orders, ORDER_SQL),
    "plan_endpoints": (plan_endpoints, ENDPOINT_SQL),
    "configuration_targets": (configuration_targets, TARGETS_SQL),
    "hosting": (hosting, HOSTING_SQL),
}


CATALOGUE |= planted.CATALOGUE | values.CATALOGUE | scenes.CATALOGUE | answers.CATALOGUE | entries.CATALOGUE


def queries() -> dict:
    return {name: run for name, (run, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
