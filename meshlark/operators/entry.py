"""Whole entries, for batches of documents: check raw JSON, and plan what is ready."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from ..sources import topology
from . import plan, readiness, review, search
from .findings import explode_findings, finding, gather

#: Levels of nesting that a document may have.
DEPTH = 64


def _faults(text: str | None) -> list[dict]:
    """Every value that a document may not hold, with its pointer: too deep, or a number that is not finite."""
    try:
        level = [("", json.loads(text))]
    except RecursionError:
        return [{"code": "json_nesting_limit", "path": ""}]
    except (ValueError, TypeError):
        return []
    out, depth = [], 0
    while level:
        if depth > DEPTH:
            return out + [{"code": "json_nesting_limit", "path": p} for p, _ in level]
        below = []
        for path, v in level:
            if isinstance(v, dict):
                below += [(f"{path}/{k.replace('~', '~0').replace('/', '~1')}", x) for k, x in v.items()]
            elif isinstance(v, list):
                below += [(f"{path}/{i}", x) for i, x in enumerate(v)]
            elif isinstance(v, float) and not math.isfinite(v):
                out.append({"code": "invalid_json_value", "path": path})
        level, depth = below, depth + 1
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("path", T.StringType())])))
def json_faults(text: pd.Series) -> pd.Series:
    return text.map(_faults)


def check_raw(raw: DataFrame) -> DataFrame:
    """(arch_id, raw) -> readiness findings; a document with values that JSON does not allow has these alone."""
    return _check(_with_faults(raw))


def _with_faults(raw: DataFrame) -> DataFrame:
    """(arch_id, raw, faults), stored: raw text is read several times.  Text that is no JSON object has no faults."""
    rows = topology.parse(raw).select("arch_id", "raw", (topology.kind_of(F.col("doc")) == "OBJECT").alias("object"), json_faults("raw").alias("faults"))
    return cut(rows.select("arch_id", "raw", F.when(F.col("object"), F.col("faults")).alias("faults")))


def _check(rows: DataFrame) -> DataFrame:
    objects = rows.select("arch_id", F.explode("faults").alias("x"))
    message = F.when(F.col("x.code") == "json_nesting_limit", f"JSON nesting must not exceed {DEPTH} levels; cycles are invalid.").otherwise("Use JSON values with finite numbers only.")
    bad = explode_findings(objects, 0, F.lit(0), [finding(F.lit(True), 0, F.col("x.code"), F.col("x.path"), message)])
    clean = topology.parse(rows.where("faults is null or size(faults) = 0"))
    return gather(bad, readiness.check(topology.devices(clean), topology.links(clean), topology.headers(clean)))


def ready(raw: DataFrame, found: DataFrame) -> DataFrame:
    """(arch_id, raw, errors, ready): documents without an error are ready."""
    errors = found.where("severity = 'error'").groupBy("arch_id").agg(F.count(F.lit(1)).alias("errors"))
    out = raw.select("arch_id", "raw").join(errors, "arch_id", "left").withColumn("errors", F.coalesce("errors", F.lit(0).cast("long")))
    return out.withColumn("ready", F.col("errors") == 0)


def plan_all(raw: DataFrame, cards: DataFrame, offers: DataFrame, models: search.Models | None = None, answers: DataFrame | None = None, k: int = search.TOP_K) -> DataFrame:
    """(arch_id, raw) -> (arch_id, ready, errors, refused, instance_type, plan, rule_ids, limitations, problem), a row for each document.

    Only ready documents are hosted, get cards and are planned; ``refused`` says why one
    has no hosting.  ``answers`` (arch_id, content) are reviewers' answers: picked
    limitations of good ones are added, ``problem`` names what is wrong with others.
    """
    raw = _with_faults(raw)
    state = cut(ready(raw, _check(raw)))
    docs = topology.parse(state.where("ready").select("arch_id", "raw"))
    devices, links = cut(topology.devices(docs)), cut(topology.links(docs))
    hosting = plan.select_hosting(devices, links, offers)
    rules = search.retrieve(cards, devices, links, k, models)
    cited = rules.groupBy("arch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rule_id"))), lambda x: x["rule_id"]).alias("rule_ids"))
    open_points = plan.limitations(devices, links)
    out = state.select("arch_id", "ready", "errors").join(hosting.select("arch_id", "refused", "instance_type"), "arch_id", "left")
    out = out.join(review.cloud_plans(devices, links, hosting), "arch_id", "left").join(cited, "arch_id", "left").join(open_points, "arch_id", "left")
    if answers is None:
        return out.withColumn("problem", F.lit(None).cast("string"))
    options = devices.groupBy("arch_id").agg(review.options(F.collect_set(F.lower("type"))).alias("options"))
    judged = review.answer_problems(answers.join(cited, "arch_id").join(options, "arch_id")).select("arch_id", "problem", "picked")
    out = out.join(judged, "arch_id", "left")
    both = F.when(F.col("problem").isNull() & F.col("picked").isNotNull(), F.array_distinct(F.concat("limitations", "picked"))).otherwise(F.col("limitations"))
    return out.withColumn("limitations", both).drop("picked")
