"""Plan documents, and their review by an injected language model: contexts, budgets and checks of answers."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import plan

# Lines of a card that are no content, and caveats that a review may pick.
METADATA = ("#", "Rule-ID:", "Kind:", "Mode:", "Phase:", "Status:", "Keywords:", "Sources:", "Related:")
OPTIONS = (
    "Linux runtimes do not establish exact vendor hardware or operating-system behavior.",
    "Runtime link state, interface state and ICMP filtering require packet-level verification.",
)
SWITCH_OPTION = "The switch runtime must preserve individual ports and switching paths; flattening source switches would change fault behavior."
ROUTER_OPTION = "Routing-daemon installation, protocol support and convergence remain unverified until the later configuration stage."
# Tokens allowed for a request, kept for the answer and for framing; entries and characters of an answer.
BUDGET, COMPLETION, FRAMING = 7000, 1536, 256
MOST_ENTRIES, MOST_CHARS = 8, 400
# The parts of a plan that do not depend on the topology.
WORKER = "lab_worker"
RESOURCES = [
    {"id": "lab_vpc", "type": "aws_vpc", "cidr_ref": "deployment.transport_vpc_cidr"},
    {"id": "lab_subnet", "type": "aws_subnet", "vpc_ref": "lab_vpc", "cidr_ref": "deployment.transport_subnet_cidr", "public_ipv4": False},
    {"id": "worker_security", "type": "aws_security_group", "vpc_ref": "lab_vpc", "ingress": [], "egress": []},
]
ISOLATION = dict.fromkeys(("worker_forwards_lab_traffic", "management_enters_lab", "automatic_masquerade", "automatic_proxy_arp"), False)
INITIAL = {
    **{k: [] for k in ("static_routes", "default_gateways", "routing_protocols", "services")},
    "connected_routes": "from_exact_endpoint_addresses", "router_ipv4_forwarding": True, "host_ipv4_forwarding": False, "bridge_stp": False, "configuration_stage": "deferred_to_external_agent",
}
DEPENDENCIES = [
    "Resolve transport CIDRs, an eligible Linux AMI and worker management access.",
    "Implement isolated node runtimes and exact veth links before applying later configuration.",
    "Validate sizing, storage and total deployment cost before provisioning.",
]


def content(c: Column) -> Column:
    """A card's text without blank lines and metadata."""
    keep = lambda x: (F.trim(x) != "") & ~F.exists(F.array(*[F.lit(m) for m in METADATA]), lambda m: x.startswith(m))
    return F.array_join(F.filter(F.split(c, "\n"), keep), "\n")


def options(roles: Column) -> Column:
    """The caveats that apply to a document with these roles."""
    has = lambda *r: F.arrays_overlap(roles, F.array(*[F.lit(x) for x in r]))
    return F.array_compact(F.array(*[F.lit(o) for o in OPTIONS], F.when(has("switch", "bridge"), SWITCH_OPTION), F.when(has("router"), ROUTER_OPTION)))


def _ordered(rows: DataFrame, order: list[str], entry: Column, name: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(*order, F.to_json(entry, {"ignoreNullFields": "false"}).alias("j"))))
    return rows.groupBy("arch_id").agg(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["j"]), ","), F.lit("]")).alias(name))


def cloud_plans(devices: DataFrame, links: DataFrame, hosting: DataFrame) -> DataFrame:
    """(arch_id, plan: JSON) of documents that hosting accepts: every device, link end and configuration target of the source."""
    net = F.col("network")
    block = lambda fields: F.struct(*[(net[f]["text"].try_cast("int") if f == "prefix_length" else net[f]["text"]).alias(f) for f in fields])
    kinds = plan.device_mapping(devices).drop("pos")
    mapped = devices.select("arch_id", "pos", F.col("id").alias("device_id"), "name", "type", block(("ip_address", "prefix_length", "subnet_mask", "network_address")).alias("network")).join(kinds, ["arch_id", "device_id"])
    entry = F.struct("device_id", "name", "type", "network", F.lit(WORKER).alias("resource_ref"), F.struct("kind", F.col("runtime_id").alias("id"), "filesystem_isolation").alias("runtime"))
    parts = _ordered(mapped, ["pos"], entry, "device_mapping")
    ends = plan.plan_endpoints(devices, links).withColumn("end", F.struct("device_id", "runtime_ref", "interface_id", "ip_address", "prefix_length"))
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("end"))).alias(s)
    both = ends.groupBy("arch_id", "pos", "link_id").agg(at("source"), at("target"))
    shape = links.select("arch_id", F.col("id").alias("link_id"), block(("network_address", "prefix_length", "subnet_mask", "source_ip", "target_ip")).alias("network"))
    entry = F.struct("link_id", F.lit("veth").alias("implementation"), F.lit(WORKER).alias("resource_ref"), "network", "source", "target")
    parts = parts.join(_ordered(both.join(shape, ["arch_id", "link_id"]), ["pos"], entry, "links"), "arch_id", "left").hint("merge")
    entry = F.struct("device_id", F.lit(WORKER).alias("resource_ref"), "runtime_ref", F.lit("deployment.worker_management").alias("management_ref"), "interface_refs")
    parts = parts.join(_ordered(plan.configuration_targets(devices, links), ["pos"], entry, "targets"), "arch_id").hint("merge")
    rows = parts.join(hosting.where("refused is null"), "arch_id")
    fixed = lambda v: F.lit(json.dumps(v, separators=(",", ":")))
    worker = F.concat(F.lit('{"id":"' + WORKER + '","type":"aws_instance","instance_type":"'), "instance_type", F.lit('","subnet_ref":"lab_subnet","security_group_refs":["worker_security"],"image_ref":"deployment.linux_ami_x86_64","public_ipv4":false,"cpu_credits":"standard"}'))
    host = F.to_json(F.struct(F.lit(1).alias("instance_count"), "instance_type", F.col("required_mib").alias("reserved_memory_mib"), F.col("hourly_compute_usd").cast("string").alias("hourly_compute_estimate")))
    doc = F.concat(
        F.lit('{"contract_version":"1.0","provider":"aws","translation_mode":"behavioral_lab","hosting":'), host, F.lit(',"resources":['), F.array_join(F.array(*[fixed(r) for r in RESOURCES], worker), ","),
        F.lit('],"device_mapping":'), "device_mapping", F.lit(',"networking":{"links":'), F.coalesce("links", F.lit("[]")), F.lit(',"isolation":'), fixed(ISOLATION), F.lit('},"configuration_targets":'), "targets",
        F.lit(',"initial_configuration":'), fixed(INITIAL), F.lit(',"dependencies":'), fixed(DEPENDENCIES), F.lit(',"verification_status":"not_run"}'),
    )
    return rows.select("arch_id", doc.alias("plan"))


def leaves(plans: DataFrame) -> DataFrame:
    """(arch_id, plan) -> (arch_id, path, kind, text): every leaf, for ``plan.differences``. Depth is that of the JSON, so it walks in Arrow batches."""

    def walk(v, at=""):
        if isinstance(v, dict) and v:
            for k, x in v.items():
                yield from walk(x, f"{at}/{k}")
        elif isinstance(v, list) and v:
            for i, x in enumerate(v):
                yield from walk(x, f"{at}/{i}")
        else:
            yield at, type(v).__name__, json.dumps(v)

    def run(batches):
        for batch in batches:
            rows = [(a, *leaf) for a, p in zip(batch["arch_id"], batch["plan"], strict=True) for leaf in walk(json.loads(p))]
            yield pd.DataFrame(rows, columns=["arch_id", "path", "kind", "text"])

    return plans.select("arch_id", "plan").mapInPandas(run, f"arch_id {dict(plans.dtypes)['arch_id']}, path string, kind string, text string")


def contexts(devices: DataFrame, links: DataFrame, hosting: DataFrame, retrieved: DataFrame, cards: DataFrame) -> DataFrame:
    """(arch_id, context: JSON, rule_ids, options): what a reviewer sees: positions for ids, no labels, no unknown fields."""
    nodes = devices.select("arch_id", "id", "pos", F.lower("type").alias("role"), "network").withColumn("node", F.row_number().over(Window.partitionBy("arch_id").orderBy("pos")) - 1)
    shown = nodes.withColumn("e", F.struct("node", F.col("role").alias("type"), F.col("network")["ip_address"]["text"].alias("ip_address"), F.col("network")["prefix_length"]["text"].try_cast("int").alias("prefix_length")))
    out = _ordered(shown, ["node"], F.col("e"), "devices")
    ends = plan.plan_endpoints(devices, links).join(nodes.select("arch_id", F.col("id").alias("device_id"), "node"), ["arch_id", "device_id"])
    at = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = ends.groupBy("arch_id", "pos", "link_id").agg(at("source", "node").alias("source"), at("target", "node").alias("target"), *[at(s, f).alias(f"{s}_{f}") for s in ("source", "target") for f in ("ip_address", "prefix_length")])
    shape = links.select("arch_id", F.col("id").alias("link_id"), F.col("network")["network_address"]["text"].alias("network_address"), F.col("network")["prefix_length"]["text"].try_cast("int").alias("prefix_length"))
    entry = F.struct("source", "target", "network_address", "prefix_length", *[f"{s}_{f}" for s in ("source", "target") for f in ("ip_address", "prefix_length")])
    out = out.join(_ordered(both.join(shape, ["arch_id", "link_id"]), ["pos"], entry, "links"), "arch_id", "left")
    known = retrieved.join(cards.select("rule_id", content(F.col("text")).alias("text")), "rule_id")
    out = out.join(_ordered(known, ["place"], F.struct("rule_id", "text"), "knowledge"), "arch_id")
    ids = known.groupBy("arch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rule_id"))), lambda x: x["rule_id"]).alias("rule_ids"))
    roles = nodes.groupBy("arch_id").agg(options(F.collect_set("role")).alias("options"))
    out = out.join(ids, "arch_id").join(roles, "arch_id").join(hosting.where("refused is null").select("arch_id", "instance_type"), "arch_id")
    doc = F.concat(
        F.lit('{"topology":{"devices":'), "devices", F.lit(',"links":'), F.coalesce("links", F.lit("[]")), F.lit('},"hosting":{"workers":1,"instance_type":"'), "instance_type",
        F.lit('"},"limitation_options":'), F.to_json("options"), F.lit(',"knowledge":'), "knowledge", F.lit("}"),
    )
    return out.select("arch_id", doc.alias("context"), "rule_ids", "options")


def budgets(contexts: DataFrame, tokenizer: Callable[[str], int], system: str = "", budget: int = BUDGET) -> DataFrame:
    """Adds tokens (with answer and framing) and fits."""

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        return text.map(tokenizer)

    schema = F.to_json(F.struct("rule_ids", "options"))
    total = count(F.concat(F.lit(system), "context")) + count(schema) + COMPLETION + FRAMING
    return contexts.withColumn("tokens", total).withColumn("fits", F.col("tokens") <= budget)


def answer_problems(answers: DataFrame) -> DataFrame:
    """answers (arch_id, content, rule_ids, options) -> (arch_id, problem, ids, picked): the first thing wrong, or NULL."""
    v = F.try_parse_json("content")
    rows = answers.withColumn("v", v).withColumn("keys", F.expr("json_object_keys(content)"))
    lists = {n: F.try_variant_get("v", f"$.{n}", "array<string>") for n in ("rule_ids", "limitations")}
    rows = rows.withColumn("ids", lists["rule_ids"]).withColumn("picked", lists["limitations"])
    blank = lambda c: F.exists(c, lambda x: x.isNull() | (F.trim(x) == ""))
    twice = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    problem = (
        F.when(F.col("v").isNull(), "invalid_json")
        .when(F.col("keys").isNull(), "not_an_object")
        .when(F.size(F.array_except("keys", F.array(F.lit("rule_ids"), F.lit("limitations")))) > 0, "unexpected_section")
        .when(F.col("ids").isNull() | F.col("picked").isNull(), "missing_section")
        .when(blank("ids") | blank("picked"), "empty_string")
        .when(twice("ids") | twice("picked"), "duplicate")
        .when((F.size("picked") > MOST_ENTRIES) | F.exists("picked", lambda x: F.length(x) > MOST_CHARS), "too_long")
        .when(F.size("ids") == 0, "no_rule_cited")
        .when(F.size(F.array_except("ids", "rule_ids")) > 0, "unknown_rule")
        .when(F.size(F.array_except("picked", "options")) > 0, "unknown_limitation")
    )
    return rows.select("arch_id", problem.alias("problem"), "ids", "picked")


def review(contexts: DataFrame, client: Callable[[str], str], most: int = 1000) -> DataFrame:
    """Contexts through an injected client, on the driver and one at a time: (arch_id, content). At most ``most``, as each is a paid request."""
    rows = contexts.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} reviews; split the documents")
    kind = dict(contexts.dtypes)["arch_id"]
    return contexts.sparkSession.createDataFrame([(r["arch_id"], client(r["context"])) for r in rows], f"arch_id {kind}, content string")


def merged_limitations(required: DataFrame, answers: DataFrame) -> DataFrame:
    """Mandatory limitations first, then picked ones that are new, for answers without a problem."""
    good = answers.where("problem is null").select("arch_id", "picked")
    return required.join(good, "arch_id").select("arch_id", F.array_distinct(F.concat("limitations", "picked")).alias("limitations"))


def recall(retrieved: DataFrame, cases: DataFrame) -> DataFrame:
    """retrieved (arch_id, rule_id), cases (arch_id, required, forbidden: arrays) -> (arch_id, recall, leaked)."""
    got = retrieved.groupBy("arch_id").agg(F.collect_set("rule_id").alias("got"))
    rows = cases.join(got, "arch_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    share = F.when(F.size("required") == 0, 1.0).otherwise(F.size(F.array_intersect("required", "got")) / F.size("required"))
    return rows.select("arch_id", share.alias("recall"), F.array_intersect("forbidden", "got").alias("leaked"))

