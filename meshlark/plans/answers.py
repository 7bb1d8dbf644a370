"""Queries over small topologies: retrieval of cards, reviews and their answers, corrections, allocation; and over card files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addr
from ..operators import allocation, corrections, graph, plan, review, search, validation
from ..sources import cards, sinks
from ..sources.topology import typed_block
from . import planted
from .lineage import cut, spread
from .views import dotted

MINIS = 8
#: Devices (id, type, prefix) and links (source, target, prefix, addresses) of the small topologies, by case.
DEVICES = [
    [("r", "router", 24), ("p", "pc", 24)], [("a", "pc", 24), ("b", "pc", 24)], [("s", "switch", None), ("a", "pc", 24), ("b", "pc", 24)], [("a", "pc", 24), ("r", "Router", 24)],
    [("s", "bridge", None), ("a", "pc", 24)], [("a", "server", 31), ("b", "server", 31)], [("s", "switch", None), ("t", "switch", None), ("u", "switch", None)], [("s", "switch", None), ("a", "pc", 24), ("b", "pc", 24)],
]
LINKS = [[("r", "p", 24)], [("a", "b", 24)], [("a", "s", 24), ("b", "s", 24)], [], [("a", "s", 24), ("a", "s", 24)], [("a", "b", 31)], [("s", "t", 24), ("t", "u", 24), ("u", "s", 24)], [("a", "s", 24), ("b", "s", 24)]]
#: A corpus of cards: (rule_id, text, mode, phase, place); required ones, examples, and others that compete.
WORDS = "switch chain loop bridge paths ping local same router pc server peer traffic cabled prefix route host mapping device lab connected topology".split()
CARDS = [(r, f"# {r}\nRule-ID: {r}\nMode: all\n\nrequired card {r}", "all", "topology") for r in (*search.ALWAYS, "L2-001", "L2-003", "ROUTE-001")]
CARDS += [(r, f"example of {r} with every word {' '.join(WORDS)}", "all", "topology") for r in ("EX-PC-DIRECT", "EX-LAN", "EX-PREFIX31", "EX-STANDALONE", "EX-ISOLATED")]
CARDS += [(f"T-{99 - i:02d}", " ".join(WORDS[(i * 7 + j * (i % 5 + 1)) % len(WORDS)] for j in range(4 + i % 6)), ("all", "behavioral_lab", "cloud_native")[i % 7 % 3], "configuration" if i % 9 == 8 else "topology") for i in range(40)]
CARDS = [(*c, i) for i, c in enumerate(CARDS)]


def minis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Devices and links of a small topology for each customer."""
    customer = spread(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey").select(F.col("c_custkey").alias("arch_id"), (F.col("c_custkey") % MINIS).cast("int").alias("case"))
    no = (F.col("arch_id") % 200).cast("string")
    ip = lambda n: F.concat(F.lit("10."), no, F.lit(".0."), n.cast("string"))
    table = lambda rows, names: F.from_json(F.lit(json.dumps([[dict(zip(names, (i, *r), strict=True)) for i, r in enumerate(case)] for case in rows])), "array<array<struct<" + ", ".join(f"{n}: {'int' if n in ('pos', 'prefix') else 'string'}" for n in names) + ">>>")
    d = customer.select("arch_id", F.explode(F.get(table(DEVICES, ("pos", "id", "type", "prefix")), F.col("case"))).alias("d")).select("arch_id", "d.*")
    p = F.col("prefix")
    own = F.when(p.isNotNull(), ip(F.col("pos") + F.when(p == 31, 0).otherwise(1)))
    block = typed_block({"ip_address": own, "prefix_length": p, "subnet_mask": addr.prefix_to_mask(p), "network_address": F.when(p.isNotNull(), ip(F.lit(0)))})
    devices = d.select("arch_id", "pos", F.lit(True).alias("is_object"), "id", F.upper("id").alias("name"), "type", block.alias("network"))
    k = customer.select("arch_id", "case", F.explode(F.get(table(LINKS, ("pos", "source", "target", "prefix")), F.col("case"))).alias("l")).select("arch_id", "case", "l.*")
    at = lambda side: F.when(F.col("case") == 7, F.when(F.col(side) != "s", ip(F.lit(9)))).when(F.col(side).isin("s", "t", "u"), None).otherwise(ip(F.when(F.col("case") == 2, F.col("pos") + 2).otherwise(F.lit(1 if side == "source" else 2) + F.when(p == 31, -1).otherwise(0)).cast("int")))
    block = typed_block({"network_address": ip(F.lit(0)), "prefix_length": p, "subnet_mask": addr.prefix_to_mask(p), "source_ip": at("source"), "target_ip": at("target")})
    links = k.select("arch_id", "pos", F.lit(True).alias("is_object"), F.concat(F.lit("l"), F.col("pos").cast("string")).alias("id"), "source", "target", block.alias("network"))
    empty = lambda df: df.withColumn("network6", F.when(F.lit(False), F.col("network")))
    return empty(devices), empty(links)


def corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CARDS, "rule_id string, text string, mode string, phase string, place int")


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


MINI = f"""
c AS (SELECT c_custkey AS arch_id, c_custkey % {MINIS} AS c, c_custkey % 200 AS no FROM customer),
dv(c, pos, id, type, prefix) AS (VALUES {_values([(i, j, *d) for i, case in enumerate(DEVICES) for j, d in enumerate(case)])}),
lk(c, pos, source, target, prefix) AS (VALUES {_values([(i, j, *k) for i, case in enumerate(LINKS) for j, k in enumerate(case)])}),
d AS (SELECT arch_id, no, dv.* FROM c JOIN dv USING (c)), l AS (SELECT arch_id, no, lk.* FROM c JOIN lk USING (c)),
ends AS (SELECT arch_id, pos, source AS id, target AS other FROM l UNION ALL SELECT arch_id, pos, target, source FROM l),
roles AS (SELECT arch_id, id, lower(type) AS role FROM d),
e AS (SELECT ends.*, a.role, b.role AS other_role FROM ends JOIN roles a ON a.arch_id = ends.arch_id AND a.id = ends.id JOIN roles b ON b.arch_id = ends.arch_id AND b.id = ends.other),
facts AS (SELECT c.arch_id, (SELECT list(DISTINCT role ORDER BY role) FROM roles r WHERE r.arch_id = c.arch_id) AS roles,
 EXISTS (SELECT 1 FROM d WHERE d.arch_id = c.arch_id AND prefix IN (31, 32)) OR EXISTS (SELECT 1 FROM l WHERE l.arch_id = c.arch_id AND prefix IN (31, 32)) AS small, EXISTS (SELECT 1 FROM e WHERE e.arch_id = c.arch_id AND role IN ('pc', 'server') AND other_role IN ('pc', 'server') AND id <> other) AS cabled,
 EXISTS (SELECT id FROM e WHERE e.arch_id = c.arch_id AND role IN ('switch', 'bridge', 'hub') AND other_role IN ('pc', 'server') GROUP BY id HAVING count(DISTINCT other) >= 2) AS shared, EXISTS (SELECT id FROM e WHERE e.arch_id = c.arch_id AND role IN ('switch', 'bridge', 'hub') AND other_role IN ('pc', 'server') GROUP BY id HAVING count(*) >= 2) AS twice,
 EXISTS (SELECT 1 FROM d ANTI JOIN ends ON ends.arch_id = d.arch_id AND ends.id = d.id WHERE d.arch_id = c.arch_id) AS alone, (SELECT count(*) FROM d WHERE d.arch_id = c.arch_id) > 1 AND NOT EXISTS (SELECT 1 FROM l WHERE l.arch_id = c.arch_id) AS apart FROM c),
pins AS (SELECT arch_id, list_concat({list(search.ALWAYS)}, CASE WHEN list_has_any(roles, ['switch', 'bridge', 'hub']) THEN ['L2-001', 'L2-003'] ELSE [] END, CASE WHEN list_contains(roles, 'router') THEN ['ROUTE-001'] ELSE [] END, CASE WHEN cabled THEN ['EX-PC-DIRECT'] ELSE [] END,
 CASE WHEN shared THEN ['EX-LAN'] ELSE [] END, CASE WHEN small THEN ['EX-PREFIX31'] ELSE [] END, CASE WHEN alone THEN ['EX-STANDALONE'] ELSE [] END, CASE WHEN apart THEN ['EX-ISOLATED'] ELSE [] END) AS pinned,
 [x FOR x IN [concat('device mapping ', array_to_string(roles, ' ')), CASE WHEN list_has_any(roles, ['switch', 'bridge']) THEN 'switch chain bridge STP loop switching paths' END, CASE WHEN small THEN 'point-to-point /31 /32 host route prefix' END,
 CASE WHEN cabled THEN 'two directly cabled PCs local traffic peer' END, CASE WHEN twice THEN 'same switch same VLAN local ping ARP' END] IF x IS NOT NULL] AS asks FROM facts),
q AS MATERIALIZED (SELECT *, concat('{search.QUERY_PREFIX} ', array_to_string(asks, ' ')) AS text FROM pins),
cards(rule_id, text, mode, phase, place) AS (VALUES {_values(CARDS)}),
pick AS MATERIALIZED (SELECT q.arch_id, cards.rule_id, cards.text, cards.place, regexp_extract_all(lower(cards.text), '[a-z0-9]+') AS w FROM q CROSS JOIN cards WHERE mode IN ('all', 'behavioral_lab') AND phase = 'topology' AND NOT starts_with(rule_id, 'EX-') AND NOT list_contains(pinned, rule_id)),
size AS (SELECT arch_id, count(*) AS n, avg(len(w)) AS a FROM pick GROUP BY arch_id),
tf AS (SELECT p.arch_id, rule_id, any_value(len(w)) AS l, term, count(*) AS tf FROM (SELECT arch_id, rule_id, w, unnest(w) AS term FROM pick) p JOIN (SELECT DISTINCT arch_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM q) t USING (arch_id, term) GROUP BY p.arch_id, rule_id, term),
df AS (SELECT arch_id, term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT arch_id, rule_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN df USING (arch_id, term) JOIN size USING (arch_id) GROUP BY ALL),
lexical AS MATERIALIZED (SELECT pick.arch_id, pick.rule_id, pick.place, row_number() OVER (PARTITION BY pick.arch_id ORDER BY round(coalesce(score, 0), 9) DESC, pick.place) AS rank FROM pick LEFT JOIN bm USING (arch_id, rule_id)),
first AS (SELECT arch_id, unnest(range(1, len(pinned) + 1))::INT AS place, unnest(pinned) AS rule_id, true AS pinned, len(pinned) AS n FROM pins)"""


def retrieved_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required cards and the two best others of each topology, lexical."""
    return search.retrieve(corpus(spark), *minis(spark, sf_dir))


RETRIEVED_SQL = f"WITH {MINI.strip()}\nSELECT arch_id, place, rule_id, pinned FROM first UNION ALL SELECT lexical.arch_id, (rank + len(q.pinned))::INT, rule_id, false FROM lexical JOIN q USING (arch_id) WHERE rank <= 2"


def letter_counts(texts: pd.Series) -> pd.Series:
    """A stand-in for an embedder."""
    return texts.map(lambda t: [1.0, *(float(t.count(c)) for c in "aste")])


MODELS = search.Models(list, "".join, letter_counts, search.token_overlap)


def hybrid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with windows of 160 tokens, similarity, fusion, and a reranker of the first candidates; models are stand-ins."""
    return search.retrieve(corpus(spark), *minis(spark, sf_dir), models=MODELS)


_VECTOR = lambda t: "[1.0::DOUBLE, " + ", ".join(f"(length({t}) - length(replace({t}, '{c}', '')))::DOUBLE" for c in "aste") + "]"
HYBRID_SQL = f"""WITH {MINI.strip()},
full_query AS (SELECT arch_id, unnest(list_concat([text], asks)) AS t FROM q),
win AS MATERIALIZED (SELECT DISTINCT arch_id, substr(t, i + 1, 160) AS win FROM (SELECT arch_id, t, unnest(range(0, length(t), 160)) AS i FROM full_query)),
near AS (SELECT p.arch_id, p.rule_id, p.place, max(round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 12)) AS score FROM (SELECT *, {_VECTOR("text")} AS u FROM pick) p JOIN (SELECT *, {_VECTOR("win")} AS v FROM win) w USING (arch_id) GROUP BY ALL),
dense AS (SELECT *, row_number() OVER (PARTITION BY arch_id ORDER BY score DESC, place) AS rank FROM near),
fused AS (SELECT dense.arch_id, dense.rule_id, row_number() OVER (PARTITION BY dense.arch_id ORDER BY round(1.0::DOUBLE / (60 + dense.rank) + 1.0::DOUBLE / (60 + lexical.rank), 12) DESC, dense.place) AS fused FROM dense JOIN lexical USING (arch_id, rule_id)),
scored AS (SELECT f.arch_id, f.rule_id, f.fused, max(len(list_intersect(list_distinct(pick.w), list_distinct(regexp_extract_all(lower(win), '[a-z0-9]+'))))) AS score FROM fused f JOIN pick USING (arch_id, rule_id) JOIN win USING (arch_id) WHERE fused <= 16 GROUP BY ALL),
last AS (SELECT *, row_number() OVER (PARTITION BY arch_id ORDER BY score DESC, fused) AS rank FROM scored)
SELECT arch_id, place, rule_id, pinned FROM first UNION ALL SELECT last.arch_id, (rank + len(q.pinned))::INT, rule_id, false FROM last JOIN q USING (arch_id) WHERE rank <= 2"""


# ------------------------------------------------------------------ reviews
def plan_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every plan leaves open, addresses used twice on a LAN, and switch cycles."""
    out = plan.limitations(*minis(spark, sf_dir))
    return out.select("arch_id", F.size("limitations").alias("n"), F.array_join(F.slice("limitations", 5, 9), "; ").alias("more"))


LIMITATION_SQL = f"""
SELECT c_custkey AS arch_id, CASE WHEN c_custkey % 8 IN (6, 7) THEN 5 ELSE 4 END AS n, CASE c_custkey % 8 WHEN 6 THEN '{plan.CYCLE}' WHEN 7 THEN concat('Address 10.', c_custkey % 200, '.0.9 is also used by device ''a'' on this LAN; preserve only if intentional.') ELSE '' END AS more FROM customer"""


def _hosting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    devices, links = minis(spark, sf_dir)
    return devices, links, plan.select_hosting(devices, links, plan.offers(spark))


def plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the plan documents of the small topologies."""
    p = review.cloud_plans(*_hosting(spark, sf_dir))
    at = lambda path: F.get_json_object("plan", path)
    return p.select(
        "arch_id", at("$.hosting.instance_type").alias("instance"), at("$.hosting.reserved_memory_mib").cast("long").alias("memory"), F.json_array_length(at("$.device_mapping")).cast("long").alias("devices"), F.json_array_length(at("$.networking.links")).cast("long").alias("links"),
        at("$.device_mapping[0].runtime.id").alias("runtime"), at("$.device_mapping[1].runtime.kind").alias("kind"), at("$.networking.links[0].source.interface_id").alias("interface"), at("$.networking.links[0].source.ip_address").alias("ip"), at("$.networking.links[0].target.prefix_length").cast("int").alias("prefix"),
        at("$.resources[3].instance_type").alias("worker"), at("$.initial_configuration.router_ipv4_forwarding").alias("forwarding"), at("$.verification_status").alias("status"),
    )


DOCUMENT_SQL = f"""
WITH {MINI.split("ends AS")[0].strip().rstrip(",")},
m AS (SELECT arch_id, any_value(no) AS no, any_value(c) AS c, count(*) AS devices, (512 + sum(CASE lower(type) WHEN 'pc' THEN 128 WHEN 'server' THEN 256 WHEN 'router' THEN 256 ELSE 64 END))::BIGINT AS memory, arg_min(id, pos) AS first_id, max(CASE WHEN pos = 1 THEN CASE WHEN lower(type) IN ('switch', 'bridge') THEN 'linux_bridge' ELSE 'network_namespace' END END) AS kind FROM d GROUP BY arch_id),
n AS (SELECT m.*, (SELECT count(*) FROM l WHERE l.arch_id = m.arch_id) AS links FROM m)
SELECT arch_id, 't3a.micro' AS instance, memory, devices, links, concat('n', substr(sha256(first_id), 1, 12)) AS runtime, kind, CASE WHEN links > 0 THEN concat('va', substr(sha256('l0'), 1, 12)) END AS interface,
 CASE c WHEN 0 THEN concat('10.', no, '.0.1') WHEN 1 THEN concat('10.', no, '.0.1') WHEN 2 THEN concat('10.', no, '.0.2') WHEN 4 THEN concat('10.', no, '.0.1') WHEN 5 THEN concat('10.', no, '.0.0') WHEN 7 THEN concat('10.', no, '.0.9') END AS ip,
 CASE c WHEN 0 THEN 24 WHEN 1 THEN 24 WHEN 5 THEN 31 END AS prefix, 't3a.micro' AS worker, 'true' AS forwarding, 'not_run' AS status FROM n"""


def review_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer sees of the small topologies: positions for ids, roles' caveats, cards without metadata."""
    devices, links, hosting = _hosting(spark, sf_dir)
    out = review.contexts(devices, links, hosting, search.retrieve(corpus(spark), devices, links), corpus(spark))
    at = lambda path: F.get_json_object("context", path)
    return out.select("arch_id", F.size("rule_ids").alias("rules"), F.size("options").alias("options"), at("$.topology.devices[1].type").alias("role"), at("$.topology.links[0].source").cast("int").alias("source"), at("$.topology.links[0].target").cast("int").alias("target"), at("$.knowledge[0].text").alias("card"), at("$.hosting.workers").cast("int").alias("workers"))


CONTEXT_SQL = f"""WITH {MINI.strip()},
pos AS (SELECT l.arch_id, s.pos AS source, t.pos AS target FROM l JOIN d s ON s.arch_id = l.arch_id AND s.id = l.source JOIN d t ON t.arch_id = l.arch_id AND t.id = l.target WHERE l.pos = 0)
SELECT q.arch_id, len(q.pinned) + 2 AS rules, 2 + list_has_any(roles, ['switch', 'bridge'])::INT + list_contains(roles, 'router')::INT AS options, (SELECT lower(type) FROM d WHERE d.arch_id = q.arch_id AND d.pos = 1) AS role, source, target, 'required card CORE-001' AS card, 1 AS workers
FROM q JOIN facts USING (arch_id) LEFT JOIN pos USING (arch_id)"""


def review_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of requests, with answer and framing, against the budget."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    rows = docs.select(F.col("doc_id").alias("arch_id"), F.col("text").alias("context"), F.array(F.lit("R-1")).alias("rule_ids"), F.array(F.lit("one"), F.lit("two")).alias("options"))
    return review.budgets(rows, lambda t: -(-len(t.encode()) // 4), "system").select("arch_id", "tokens", "fits")


BUDGET_SQL = f"""SELECT doc_id AS arch_id, t AS tokens, t <= {review.BUDGET} AS fits FROM (SELECT doc_id, ((6 + strlen(text) + 3) // 4 + (length('{{"rule_ids":["R-1"],"options":["one","two"]}}') + 3) // 4 + {review.COMPLETION + review.FRAMING})::BIGINT AS t FROM documents WHERE text IS NOT NULL)"""

ANSWERS = [
    ('{"rule_ids":["R-1"],"limitations":["one"]}', None), ('{"rule_ids":["R-1"', "invalid_json"), ("[1]", "not_an_object"), ('{"rule_ids":["R-1"],"limitations":[],"plan":1}', "unexpected_section"), ('{"rule_ids":["R-1"]}', "missing_section"), ('{"rule_ids":["R-1"],"limitations":[" "]}', "empty_string"),
    ('{"rule_ids":["R-1","R-1"],"limitations":[]}', "duplicate"), (json.dumps({"rule_ids": ["R-1"], "limitations": [f"x{i}" for i in range(9)]}), "too_long"), ('{"rule_ids":[],"limitations":[]}', "no_rule_cited"), ('{"rule_ids":["R-9"],"limitations":[]}', "unknown_rule"), ('{"rule_ids":["R-2"],"limitations":["three"]}', "unknown_limitation"),
    ('{"rule_ids":["R-2","R-1"],"limitations":["two","one"]}', None),
]


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("arch_id"))
    content = F.element_at(F.array(*[F.lit(a) for a, _ in ANSWERS]), (F.col("arch_id") % len(ANSWERS) + 1).cast("int"))
    return review.answer_problems(orders.select("arch_id", content.alias("content"), F.array(F.lit("R-1"), F.lit("R-2")).alias("rule_ids"), F.array(F.lit("one"), F.lit("two")).alias("options")))


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing that is wrong with each answer."""
    return _answers(spark, sf_dir).select("arch_id", "problem")


ANSWER_SQL = f"SELECT o_orderkey AS arch_id, problem FROM orders JOIN (VALUES {_values([(i, p) for i, (_, p) in enumerate(ANSWERS)])}) AS t(c, problem) ON c = o_orderkey % {len(ANSWERS)}"


def merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mandatory limitations, then what good answers picked that is new."""
    answers = _answers(spark, sf_dir)
    required = answers.select("arch_id", F.array(F.lit("zero"), F.when(F.col("arch_id") % 5 == 0, "one").otherwise("five")).alias("limitations"))
    return review.merged_limitations(required, answers).select("arch_id", F.array_join("limitations", ",").alias("limitations"))


MERGED_SQL = f"""
SELECT o_orderkey AS arch_id, concat('zero,', CASE WHEN o_orderkey % 5 = 0 THEN 'one' ELSE 'five' END, CASE WHEN o_orderkey % {len(ANSWERS)} = 11 THEN ',two' ELSE '' END, CASE WHEN o_orderkey % 5 > 0 THEN ',one' ELSE '' END) AS limitations FROM orders WHERE o_orderkey % {len(ANSWERS)} IN (0, 11)"""


def rule_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of required rules and forbidden ones that came up."""
    o = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("arch_id"), F.concat(F.lit("R-"), (F.col("l_partkey") % 6).cast("string")).alias("rule_id"))
    cases = o.select("arch_id").distinct().withColumn("required", F.when(F.col("arch_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("R-0"), F.lit("R-1"), F.lit("R-2")))).withColumn("forbidden", F.array(F.lit("R-5"), F.lit("R-4")))
    out = review.recall(o.where("rule_id <> 'R-3'"), cases)
    return out.select("arch_id", F.round("recall", 6).alias("recall"), F.array_join("leaked", ",").alias("leaked"))


RECALL_SQL = """
SELECT l_orderkey AS arch_id, CASE WHEN l_orderkey % 4 = 0 THEN 1.0 ELSE round(count(DISTINCT l_partkey % 6) FILTER (l_partkey % 6 <= 2) / 3.0, 6) END::DOUBLE AS recall,
 concat_ws(',', CASE WHEN bool_or(l_partkey % 6 = 5) THEN 'R-5' END, CASE WHEN bool_or(l_partkey % 6 = 4) THEN 'R-4' END) AS leaked FROM lineitem GROUP BY l_orderkey"""

# ------------------------------------------------------------------ corrections
_NET = {"prefix_length": 24, "subnet_mask": "255.255.255.0", "network_address": "10.K.0.0"}
DOC = {
    "devices": [{"id": "a", "name": "PC1", "type": "pc", "network": {"ip_address": "10.K.0.1", **_NET}}, {"id": "b", "name": "PC2", "type": "pc", "network": {"ip_address": "10.K.0.2", **_NET}}, {"id": "c", "name": "pc2 ", "type": "server", "network": {"ip_address": "10.K.9.3", **_NET, "network_address": "10.K.9.0"}}],
    "links": [{"id": "l", "source": "a", "target": "b", "network": {**_NET, "source_ip": "10.K.0.1", "target_ip": "10.K.0.2"}}],
}
#: Batches of (entity, path, value); whether the revision is current; the status, and what changes.
BATCHES = [
    ([["a", "/devices/0/network/ip_address", "10.K.0.9"]], True, "applied", {"ip": "10.K.0.9", "end": "10.K.0.9"}), ([["a", "/devices/0/name", "X"]], False, "stale_revision", {}), ([["b", "/devices/0/name", "X"]], True, "wrong_entity", {}),
    ([["a", "/devices/0/network", {}], ["a", "/devices/0/network/ip_address", "10.K.0.9"]], True, "overlapping_paths", {}), ([["a", "/devices/0/color", "X"]], True, "unsupported_path", {}), ([["a", "/devices/0/name"]], True, "invalid_correction", {}),
    ([["a", "/devices/0/id", "z"]], True, "applied", {"source": "z"}), ([["a", "/devices/0/network/prefix_length", 16]], True, "applied", {"mask": "255.255.0.0", "base": "10.K.0.0"}), ([["a", "/devices/0/network/subnet_mask", "255.255.255.128"]], True, "applied", {"mask": "255.255.255.128"}),
    ([["l", "/links/0/network/source_ip", "10.K.0.7"]], True, "applied", {"ip": "10.K.0.7", "end": "10.K.0.7"}),
]


def _at_key(c: Column) -> Column:
    return F.replace(c, F.lit("K"), F.col("k").cast("string"))


def _cased(spark: SparkSession, sf_dir: str, items: list) -> DataFrame:
    """(arch_id, k, raw, corrections, case): the document of each customer, and the corrections of its case."""
    customer = spread(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey").select(F.col("c_custkey").cast("string").alias("arch_id"), (F.col("c_custkey") % 200).alias("k"), (F.col("c_custkey") % len(items)).cast("int").alias("case"))
    return customer.withColumn("raw", _at_key(F.lit(json.dumps(DOC)))).withColumn("corrections", _at_key(F.get(F.array(*[F.lit(json.dumps(i)) for i in items]), F.col("case"))))


def batch_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches bound to a revision, all or nothing, with what follows from them."""
    rows = _cased(spark, sf_dir, [b for b, *_ in BATCHES])
    current = F.get(F.array(*[F.lit(x) for _, x, *_ in BATCHES]), F.col("case"))
    status, devices, links = corrections.correct_batches(rows.withColumn("revision", F.when(current, sinks.revision(F.col("raw"))).otherwise("old")))
    first = lambda df, *columns: df.where("pos = 0").select("arch_id", *columns)
    one = first(devices, F.col("ip_address.text").alias("ip"), F.col("subnet_mask.text").alias("mask"), F.col("network_address.text").alias("base"))
    two = first(links, F.col("source.text").alias("source"), F.col("source_ip.text").alias("end"))
    return status.join(one, "arch_id").join(two, "arch_id").select("arch_id", "status", "ip", "mask", "base", "source", "end")


_KEYED = lambda v: "concat(" + ", ".join(f"'{p}'" if i % 2 == 0 else "k" for i, p in enumerate([x for part in v.split("K") for x in (part, "K")][:-1])) + ")"
BATCH_SQL = "\nUNION ALL ".join(
    f"SELECT c_custkey::VARCHAR AS arch_id, '{status}' AS status, " + ", ".join(f"{_KEYED(new.get(name, old))} AS \"{name}\"" for name, old in (("ip", "10.K.0.1"), ("mask", "255.255.255.0"), ("base", "10.K.0.0"), ("source", "a"), ("end", "10.K.0.1"))) + f" FROM (SELECT c_custkey, c_custkey % 200 AS k FROM customer WHERE c_custkey % {len(BATCHES)} = {i})"
    for i, (_, _, status, new) in enumerate(BATCHES)
)
SINGLES = [
    ([{"device": "a", "name": "Desk"}], "applied", "10.K.0.1"), ([{"device": "a", "name": " pc2"}], "duplicate_device_name", "10.K.0.1"), ([{"device": "nobody", "name": "X"}], "unknown_device", "10.K.0.1"), ([{"device": "PC2", "type": "server"}], "ambiguous_device", "10.K.0.1"),
    ([{"device": "PC1", "ip": "10.K.0.300"}], "invalid_ip", "10.K.0.1"), ([{"device": "a", "ip": "10.K.0.7/24", "prefix": 25}], "prefix_mismatch", "10.K.0.1"), ([{"device": "a", "ip": "10.K.0.2"}], "duplicate_ip", "10.K.0.1"), ([{"device": "a", "ip": "10.K.3.7"}], "ip_outside_link_network", "10.K.0.1"),
    ([{"device": "c", "link": "l", "ip": "10.K.0.7"}], "link_not_on_device", "10.K.0.1"), ([{"device": "a", "ip": "10.K.0.7", "mask": "255.0.255.0"}], "invalid_subnet_mask", "10.K.0.1"), ([{"device": "a", "ip": "10.K.0.7"}, {"device": "PC1", "type": " Server "}], "applied,applied", "10.K.0.7"),
    ([{"link": "l", "network": "10.K.0.1", "prefix": 24}], "invalid_network_address", "10.K.0.1"), ([{"link": "l", "network": "10.K.0.0"}], "prefix_required", "10.K.0.1"), ([{"device": "a", "color": 1}, {"link": "none", "network": "10.K.0.0/24"}], "invalid_correction,unknown_link", "10.K.0.1"), ([{"device": "a", "ip": "10.K.0.255"}], "ip_is_broadcast_address", "10.K.0.1"),
    ([{"device": "a", "name": ""}, {"device": "a", "type": 3}], "invalid_name,invalid_type", "10.K.0.1"),
]


def single_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections one by one, with an outcome for each."""
    outcomes, devices, links = corrections.correct_each(_cased(spark, sf_dir, [c for c, *_ in SINGLES]))
    codes = outcomes.groupBy("arch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]), ",").alias("codes"))
    one, two = devices.where("pos = 0").select("arch_id", F.col("ip4").alias("ip")), links.where("pos = 0").select("arch_id", F.col("source_ip4").alias("end"))
    return codes.join(one, "arch_id").join(two, "arch_id").select("arch_id", "codes", "ip", "end")


SINGLE_SQL = "\nUNION ALL ".join(f"SELECT c_custkey::VARCHAR AS arch_id, '{codes}' AS codes, {_KEYED(ip)} AS ip, {_KEYED(ip)} AS \"end\" FROM (SELECT c_custkey, c_custkey % 200 AS k FROM customer WHERE c_custkey % {len(SINGLES)} = {i})" for i, (_, codes, ip) in enumerate(SINGLES))


# ------------------------------------------------------------------ allocation and segments
def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks for each customer's orders by size, packed into a /22, which some exceed."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    hosts = F.col("o_orderkey") % 300 + 1
    needs = orders.select(F.col("o_custkey").alias("arch_id"), F.col("o_orderkey").alias("segment_no"), hosts.alias("hosts"), addr.smallest_prefix(hosts).alias("prefix"))
    return allocation.vlsm(needs, 172 << 24 | 16 << 16, 22).select("arch_id", "segment_no", "hosts", "prefix", addr.int_to_ip(F.col("network")).alias("network"), "fits")


PACKED_SQL = f"""
WITH n AS (SELECT o_custkey AS arch_id, o_orderkey AS segment_no, o_orderkey % 300 + 1 AS hosts FROM orders),
p AS (SELECT *, (32 - ceil(log2(greatest(hosts + 2, 4))))::INT AS prefix FROM n),
s AS (SELECT *, sum(1::BIGINT << (32 - prefix)) OVER (PARTITION BY arch_id) AS whole, sum(1::BIGINT << (32 - prefix)) OVER (PARTITION BY arch_id ORDER BY prefix, segment_no ROWS UNBOUNDED PRECEDING) - (1::BIGINT << (32 - prefix)) AS off FROM p)
SELECT arch_id, segment_no, hosts, prefix, CASE WHEN whole <= 1024 THEN {dotted("(2886729728 + off)::BIGINT", "duckdb")} END AS network, whole <= 1024 AS fits FROM s"""


def planted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broadcast segments with routing switches and router boundaries among them."""
    devices, links = planted.tables(spark, sf_dir)
    known = cut(validation._known(devices))
    return graph.segments(known, validation.valid_links(links, known))[0].select("arch_id", "segment", "link_id", "pos")


SEGMENT_SQL = planted.VALIDATION.split(",\nfound(")[0] + "\nSELECT k AS arch_id, concat('segment_', no) AS segment, id AS link_id, pos FROM seg"


# ------------------------------------------------------------------ card files
CARD = """SELECT p_partkey AS k, concat('kb/', p_partkey % 10, '/', p_partkey, '.md') AS source, concat(rpad(concat('# Card ', p_partkey), 99, '.'), {nl}, rpad(concat('Rule-ID: R-', CASE WHEN p_partkey % 29 = 0 THEN p_partkey - 1 ELSE p_partkey END), 99, ' '), {nl}, rpad(concat('Mode: ', CASE WHEN p_partkey % 13 = 0 THEN 'other' ELSE 'all' END), 99, ' '), {nl},
 rpad('Phase: topology', 99, ' '), {nl}, repeat(concat(rpad(concat('line ', p_partkey), 98, 'x'), 'y', {nl}), CAST(p_partkey % 40 AS INT))) AS content FROM part"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    return spark.sql(CARD.format(nl="'\\n'").replace("FROM part", "FROM {part}"), part=part)


def card_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card files in chunks: 18 lines of 100 characters each, as more would be over 1,800."""
    out = cards.chunks(_cards(spark, sf_dir))
    return out.select("source", "chunk", F.length("heading").alias("heading"), F.sha2("text", 256).alias("sha256"))


CHUNK_SQL = f"""
WITH c AS ({CARD.format(nl="chr(10)")}), l AS (SELECT source, unnest(range(0, (k % 40 + 4 + 17) // 18)) AS chunk, k % 40 + 4 AS n, string_split(content, chr(10)) AS lines FROM c)
SELECT source, chunk::INT AS chunk, 99 AS heading, sha256(trim(array_to_string(lines[chunk * 18 + 1:least(n, chunk * 18 + 18)], chr(10)))) AS sha256 FROM l"""


def card_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the records: unknown modes, repeated ids, required rules that are missing."""
    found = cards.records(cards.chunks(_cards(spark, sf_dir)))
    trimmed = found.select(F.trim("rule_id").alias("rule_id"), "source", "heading", "text", F.trim("mode").alias("mode"), F.trim("phase").alias("phase"))
    return cards.record_problems(trimmed, ["R-1", "R-0"])


PROBLEM_SQL = """
SELECT concat('R-', CASE WHEN p_partkey % 29 = 0 THEN p_partkey - 1 ELSE p_partkey END) AS rule_id, 'unknown_mode' AS problem FROM part WHERE p_partkey % 13 = 0
UNION ALL SELECT concat('R-', p_partkey - 1), 'duplicate_rule' FROM part WHERE p_partkey % 29 = 0 AND p_partkey > 0 UNION ALL SELECT 'R-0', 'missing_rule' FROM region WHERE r_regionkey = 0"""


def card_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of card files, how many rules each has, and whether a stored cache still holds."""
    files = _cards(spark, sf_dir).select("source", "content")
    listed = cards.manifest(files, cards.records(cards.chunks(files)))
    stored = files.select("source", F.sha2(F.when(F.substring("source", -4, 1) == "7", "old").otherwise(F.col("content")), 256).alias("sha256"))
    stale = cards.fresh(stored, files).select("source", F.lit(True).alias("stale"))
    return listed.join(stale, "source", "left").select("source", "sha256", F.size("rules").alias("rules"), F.coalesce("stale", F.lit(False)).alias("stale"))


MANIFEST_SQL = f"WITH c AS ({CARD.format(nl='chr(10)')}) SELECT source, sha256(content) AS sha256, 1 AS rules, k % 10 = 7 AS stale FROM c"

LINT = """concat('Rule-ID: R-', p_partkey, {nl}, 'Kind: rule', {nl}, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('Status: ok', {nl}) END, CASE WHEN p_partkey % 7 = 0 THEN concat('Extra: x', {nl}) ELSE '' END, CASE WHEN p_partkey % 11 = 0 THEN concat('Kind: rule', {nl}) ELSE '' END,
 'Related: ', CASE WHEN p_partkey % 13 = 0 THEN 'R-none' WHEN p_partkey % 2 = 0 THEN 'none' ELSE concat('R-', p_partkey) END, {nl}, 'Sources: S-1', CASE WHEN p_partkey % 17 = 0 THEN ', S-9' ELSE '' END)"""


def card_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored cards against the list of fields, the heading's form, related rules and registered sources."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    rows = spark.sql(f"SELECT {LINT.format(nl=chr(39) + chr(92) + 'n' + chr(39))} AS text, CASE WHEN p_partkey % 19 = 0 THEN 'no heading' ELSE concat('## R', p_partkey) END AS heading FROM {{part}}", part=part)
    return cards.lint(rows, ["Rule-ID", "Kind", "Status", "Related", "Sources"], r"^## R[0-9]+$", spark.createDataFrame([("S-1",)], "source_id string"))


LINT_SQL = "\nUNION ALL ".join(
    f"SELECT concat('R-', p_partkey) AS rule_id, '{problem}' AS problem FROM part WHERE p_partkey % {n} = 0"
    for n, problem in ((5, "missing_field Status"), (7, "unexpected_field Extra"), (11, "repeated_field"), (13, "unknown_related R-none"), (17, "unknown_source S-9"), (19, "bad_heading"))
)

CATALOGUE: dict[str, tuple] = {
    "retrieved_rules": (retrieved_rules, RETRIEVED_SQL),
    "hybrid_rules": (hybrid_rules, HYBRID_SQL),
    "plan_limitations": (plan_limitations, LIMITATION_SQL),
    "plan_documents": (plan_documents, DOCUMENT_SQL),
    "review_contexts": (review_contexts, CONTEXT_SQL),
    "review_budgets": (review_budgets, BUDGET_SQL),
    "answer_checks": (answer_checks, ANSWER_SQL),
    "merged_answers": (merged_answers, MERGED_SQL),
    "rule_recall": (rule_recall, RECALL_SQL),
    "batch_corrections": (batch_corrections, BATCH_SQL),
    "single_corrections": (single_corrections, SINGLE_SQL),
    "packed_blocks": (packed_blocks, PACKED_SQL),
    "planted_segments": (planted_segments, SEGMENT_SQL),
    "card_chunks": (card_chunks, CHUNK_SQL),
    "card_problems": (card_problems, PROBLEM_SQL),
    "card_manifest": (card_manifest, MANIFEST_SQL),
    "card_lint": (card_lint, LINT_SQL),
}
