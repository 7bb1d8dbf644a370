"""A JSON kind looks its value up once, and documents are parsed without a join with themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.operators import corrections
from meshlark.sources.topology import kind_of, parse

KINDS = {"1": "BIGINT", "1.5": "DECIMAL", "1e400": "DOUBLE", '"s"': "STRING", "true": "BOOLEAN", "null": None, "[null]": "ARRAY", "{}": "OBJECT", '{"b": null}': "OBJECT"}


def test_kind_evaluates_its_value_once(spark):
    rows = spark.createDataFrame([(k, f'{{"a": {k}}}') for k in KINDS] + [("none", "{}"), ("text", "x")], "k string, raw string")
    found = rows.select("k", kind_of(F.try_variant_get(F.try_parse_json("raw"), "$.a", "variant")).alias("kind"))
    assert {r["k"]: r["kind"] for r in found.collect()} == KINDS | {"none": None, "text": None}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("variant_get") == 1


def test_parse_keeps_named_columns(spark):
    rows = spark.createDataFrame([("a", "{}", "[]")], "arch_id string, raw string, corrections string")
    assert parse(rows, "corrections").columns == ["arch_id", "raw", "doc", "finite", "corrections"]
    assert parse(rows).columns == ["arch_id", "raw", "doc", "finite"]


def test_a_repeated_document_is_not_squared(spark):
    """Two rows of one id are two documents' outcomes, not four, as a join with itself made of them."""
    rows = spark.createDataFrame([("a", "[]", "[]")] * 2, "arch_id string, raw string, corrections string")
    assert corrections.correct_each(rows)[0].count() == 2
