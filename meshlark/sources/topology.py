"""Topology documents as tables: JSON text -> VARIANT -> one row for each device and each link.

A field keeps its JSON kind beside its text, since rules distinguish ``24`` from
``24.0``, ``true`` and ``"24"``.  Kinds are NULL (absent or null), STRING, BIGINT,
DECIMAL, DOUBLE, BOOLEAN, OBJECT and ARRAY.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = "struct<kind: string, text: string>"
DEVICE_FIELDS = ("ip_address", "prefix_length", "subnet_mask", "network_address")
LINK_FIELDS = ("network_address", "prefix_length", "subnet_mask", "source_ip", "target_ip")


def kind_of(v: Column) -> Column:
    """NULL for an absent value or JSON null; ``v`` is evaluated once, which matters where it is cut out of a document."""
    return F.get(F.regexp_extract_all(F.schema_of_variant(v), F.lit(r"^(?!VOID)[A-Z]+"), F.lit(0)), F.lit(0))


def field(v: Column, path: str) -> Column:
    found = F.try_variant_get(v, path, "variant")
    return F.struct(kind_of(found).alias("kind"), F.try_variant_get(v, path, "string").alias("text"))


def string(v: Column, path: str) -> Column:
    """The text of a JSON string; NULL for anything else."""
    return F.when(kind_of(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def block(v: Column, path: str, fields: tuple[str, ...]) -> Column:
    """A network object as a struct of fields; NULL if it is no object."""
    inner = F.try_variant_get(v, path, "variant")
    return F.when(kind_of(inner) == "OBJECT", F.struct(*[field(inner, f"$.{f}").alias(f) for f in fields]))


def read(spark, path: str) -> DataFrame:
    """(arch_id, raw): one document for each JSON file under ``path``; the id is the file's path."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.input_file_name().alias("arch_id"), F.col("value").alias("raw"))


def parse(raw: DataFrame, *more: str) -> DataFrame:
    """(arch_id, raw) -> (arch_id, raw, doc: variant, finite: boolean), and the columns named in ``more``.

    ``doc`` is NULL for text that is not JSON, repeats a key or has NaN; ``finite`` is
    false where a number overflows, which the parser lets through.
    """
    numbers = F.regexp_extract_all(F.regexp_replace("raw", r'"(?:[^"\\]|\\.)*"', '""'), F.lit(r"-?[0-9]+(?:\.[0-9]+)?[eE]\+?[0-9]+"), F.lit(0))
    large = F.exists(numbers, lambda x: F.abs(x.try_cast("double")) > 1.7976931348623157e308)
    return raw.select("arch_id", "raw", F.try_parse_json("raw").alias("doc"), (~large).alias("finite"), *more)


def _items(docs: DataFrame, group: str) -> DataFrame:
    return docs.select("arch_id", F.posexplode(F.try_variant_get("doc", f"$.{group}", "array<variant>")).alias("pos", "item"))


def devices(docs: DataFrame) -> DataFrame:
    """parsed documents -> (arch_id, pos, is_object, id, name, type, network, network6)."""
    item = F.col("item")
    return _items(docs, "devices").select(
        "arch_id",
        "pos",
        F.coalesce(kind_of(item) == "OBJECT", F.lit(False)).alias("is_object"),
        *[string(item, f"$.{f}").alias(f) for f in ("id", "name", "type")],
        block(item, "$.network", DEVICE_FIELDS).alias("network"),
        block(item, "$.network6", DEVICE_FIELDS).alias("network6"),
    )


def links(docs: DataFrame) -> DataFrame:
    """parsed documents -> (arch_id, pos, is_object, id, source, target, network, network6)."""
    item = F.col("item")
    return _items(docs, "links").select(
        "arch_id",
        "pos",
        F.coalesce(kind_of(item) == "OBJECT", F.lit(False)).alias("is_object"),
        *[string(item, f"$.{f}").alias(f) for f in ("id", "source", "target")],
        block(item, "$.network", LINK_FIELDS).alias("network"),
        block(item, "$.network6", LINK_FIELDS).alias("network6"),
    )


def typed_block(fields: dict[str, Column]) -> Column:
    """Plain columns as a network struct: numbers are BIGINT, the rest STRING, nulls absent."""
    out = []
    for name, c in fields.items():
        kind = "BIGINT" if name == "prefix_length" else "STRING"
        out.append(F.struct(F.when(c.isNotNull(), kind).alias("kind"), c.cast("string").alias("text")).alias(name))
    return F.struct(*out)


def headers(docs: DataFrame) -> DataFrame:
    """(arch_id, kind, devices, links): the document's kind and the lengths of its lists (NULL if no list)."""
    size = lambda g: F.size(F.try_variant_get("doc", f"$.{g}", "array<variant>"))
    listed = lambda g: F.when(kind_of(F.try_variant_get("doc", f"$.{g}", "variant")) == "ARRAY", size(g))
    return docs.select("arch_id", kind_of(F.col("doc")).alias("kind"), "finite", listed("devices").alias("devices"), listed("links").alias("links"))
