"""The row shape that every rule produces, and its reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("arch_id", "stage", "pos", "seq", "code", "severity", "path", "message", "subject", "value", "related", "hint")


class Rule(NamedTuple):
    """A condition on a row, and what to say of the rows that meet it; texts or Columns."""

    when: Column
    seq: int
    code: str | Column
    severity: str | Column
    path: Column
    message: str | Column
    subject: Column | None
    value: Column | None
    related: Column | None
    hint: dict | None


def finding(when: Column, seq: int, code, path: Column, message, subject: Column | None = None, value: Column | None = None, related: Column | None = None, hint: dict | None = None, severity="error") -> Rule:
    """What ``explode_findings`` makes a row of, where ``when`` holds."""
    return Rule(when, seq, code, severity, path, message, subject, value, related, hint)


def _of_rule(values: list, kind: str) -> Column:
    """The value of the row's rule ``_rule``; fixed values are looked up, others computed for their own rows only."""
    if all(v is None for v in values):
        return F.lit(None).cast(kind)
    if not any(isinstance(v, Column) for v in values):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_rule") + 1)
    at, fixed = None, any(isinstance(v, str) for v in values)
    for i, v in enumerate(values):
        if isinstance(v, Column):
            at = (F if at is None else at).when(F.col("_rule") == i, v.cast(kind))
    if not fixed:
        return at
    return at.otherwise(_of_rule([None if isinstance(v, Column) else v for v in values], kind))


def _pairs(hint: dict | None) -> Column | None:
    return F.create_map(*[x for k, v in hint.items() for x in (F.lit(k), v.cast("string"))]) if hint else None


def explode_findings(df: DataFrame, stage: int, pos: Column, rules: list[Rule]) -> DataFrame:
    """One narrow pass: the numbers of the rules that a row meets, exploded; what they say is built for those rows alone."""
    rows = df.withColumn("_rule", F.explode(F.array_compact(F.array(*[F.when(r.when, F.lit(i)) for i, r in enumerate(rules)]))))
    column = lambda name, kind: _of_rule([getattr(r, name) for r in rules], kind).alias(name)
    return rows.select(
        "arch_id",
        F.lit(stage).alias("stage"),
        pos.cast("int").alias("pos"),
        column("seq", "int"),
        column("code", "string"),
        column("severity", "string"),
        column("path", "string"),
        column("message", "string"),
        column("subject", "string"),
        column("value", "string"),
        F.coalesce(column("related", "array<string>"), F.array().cast("array<string>")).alias("related"),
        F.coalesce(_of_rule([_pairs(r.hint) for r in rules], "map<string,string>"), F.create_map().cast("map<string,string>")).alias("hint"),
    ).select(*COLUMNS)


def gather(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_order(findings: DataFrame) -> DataFrame:
    """Adds rule_ord, the place within the document; for sinks, as it sorts within documents."""
    w = Window.partitionBy("arch_id").orderBy("stage", "pos", "seq", "path", "code")
    return findings.withColumn("rule_ord", F.row_number().over(w))


def counts(findings: DataFrame) -> DataFrame:
    """(arch_id, code, severity, n)."""
    return findings.groupBy("arch_id", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


def summary(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """documents (arch_id) -> (arch_id, valid, errors, warnings, codes: map), documents without findings too."""
    by_code = counts(findings)
    total = by_code.groupBy("arch_id").agg(
        F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("warnings"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("codes"),
    )
    out = documents.select("arch_id").join(total, "arch_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("arch_id", (F.coalesce("errors", zero) == 0).alias("valid"), F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"), F.coalesce("codes", F.create_map().cast("map<string,bigint>")).alias("codes"))
