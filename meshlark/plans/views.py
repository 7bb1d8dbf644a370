"""Topology tables derived from star-schema tables, by arithmetic that Spark SQL and DuckDB share.

Regions are documents and routers, nations switches, customers PCs and suppliers servers;
keys plant addresses outside their network, wrong masks, missing links and duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.topology import typed_block

DIALECT = {"spark": {"div": "div", "str": "STRING"}, "duckdb": {"div": "//", "str": "VARCHAR"}}


def dotted(v: str, dialect: str) -> str:
    """SQL text that writes the BIGINT expression ``v`` as a dotted address."""
    d = DIALECT[dialect]
    parts = [f"CAST(({v}) {d['div']} {n} % 256 AS {d['str']})" for n in (16777216, 65536, 256, 1)]
    return "concat(" + ", '.', ".join(parts) + ")"


def hosts_sql(dialect: str) -> str:
    s = DIALECT[dialect]["str"]
    return f"""
SELECT n_regionkey AS arch_id, 100 + c_custkey AS pos, concat('c', CAST(c_custkey AS {s})) AS id, 'pc' AS type, n_nationkey AS nation, c_custkey AS k
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT n_regionkey, 100000000 + s_suppkey, concat('s', CAST(s_suppkey AS {s})), 'server', n_nationkey, s_suppkey + 1000000
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def devices_sql(dialect: str) -> str:
    """(arch_id, pos, id, name, type, ip, prefix, mask, base): base is the written network address."""
    s, dot = DIALECT[dialect]["str"], lambda v: dotted(v, dialect)
    base = "(167772160 + nation * CAST(65536 AS BIGINT))"
    ip = f"({base} + 2 + k % 700 + CASE WHEN k % 53 = 0 THEN 6553600 ELSE 0 END)"
    router = "(180879360 + r_regionkey * CAST(65536 AS BIGINT))"
    return f"""
SELECT CAST(r_regionkey AS INT) AS arch_id, 0 AS pos, concat('r', CAST(r_regionkey AS {s})) AS id, concat('R', CAST(r_regionkey AS {s})) AS name, 'router' AS type,
 {dot(router + " + 1")} AS ip, 16 AS prefix, '255.255.0.0' AS mask, {dot(router)} AS base FROM region
UNION ALL
SELECT CAST(n_regionkey AS INT), 1 + n_nationkey, concat('n', CAST(n_nationkey AS {s})), concat('SW', CAST(n_nationkey AS {s})), 'switch', NULL, NULL, NULL, NULL FROM nation
UNION ALL
SELECT CAST(arch_id AS INT), CAST(pos AS INT), id, upper(id), type, {dot(ip)}, 16, CASE WHEN k % 59 = 0 THEN '255.255.255.0' ELSE '255.255.0.0' END, {dot(base)} FROM ({hosts_sql(dialect)}) h"""


def links_sql(dialect: str) -> str:
    """(arch_id, pos, id, source, target, base, prefix, mask, source_ip, target_ip)."""
    s, dot = DIALECT[dialect]["str"], lambda v: dotted(v, dialect)
    base = "(167772160 + nation * CAST(65536 AS BIGINT))"
    ip = f"({base} + 2 + k % 700 + CASE WHEN k % 53 = 0 THEN 6553600 ELSE 0 END)"
    nation = "(167772160 + n_nationkey * CAST(65536 AS BIGINT))"
    return f"""
SELECT CAST(n_regionkey AS INT) AS arch_id, CAST(n_nationkey AS INT) AS pos, concat('lr', CAST(n_nationkey AS {s})) AS id, concat('r', CAST(n_regionkey AS {s})) AS source,
 concat('n', CAST(n_nationkey AS {s})) AS target, {dot(nation)} AS base, 16 AS prefix, '255.255.0.0' AS mask, {dot(nation + " + 1")} AS source_ip, CAST(NULL AS {s}) AS target_ip
FROM nation WHERE n_nationkey % 7 <> 0
UNION ALL
SELECT CAST(arch_id AS INT), CAST(pos AS INT), concat('l', id), id, concat('n', CAST(nation AS {s})), {dot(base)}, 16, '255.255.0.0', {dot(ip)}, NULL
FROM ({hosts_sql(dialect)}) h WHERE k % 41 <> 0"""


TABLES = ("region", "nation", "customer", "supplier")


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def plain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Devices and links with plain columns."""
    tables = load(spark, sf_dir, *TABLES)
    run = lambda sql: spark.sql(_bound(sql), **tables)
    return run(devices_sql("spark")), run(links_sql("spark"))


def _bound(sql: str) -> str:
    """Table names as parameters, so that nothing is registered in the session's catalog."""
    for n in TABLES:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return sql


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Devices and links in the shape of ``sources.topology``."""
    d, k = plain(spark, sf_dir)
    device = typed_block({"ip_address": F.col("ip"), "prefix_length": F.col("prefix"), "subnet_mask": F.col("mask"), "network_address": F.col("base")})
    link = typed_block({"network_address": F.col("base"), "prefix_length": F.col("prefix"), "subnet_mask": F.col("mask"), "source_ip": F.col("source_ip"), "target_ip": F.col("target_ip")})
    devices = d.select("arch_id", "pos", F.lit(True).alias("is_object"), "id", "name", "type", device.alias("network"))
    links = k.select("arch_id", "pos", F.lit(True).alias("is_object"), "id", "source", "target", link.alias("network"))
    empty = lambda df: df.withColumn("network6", F.when(F.lit(False), F.col("network")))
    return empty(devices), empty(links)


def with_views(sql: str) -> str:
    """DuckDB SQL over ``devices`` and ``links``."""
    return f"WITH devices AS ({devices_sql('duckdb')}),\nlinks AS ({links_sql('duckdb')})\n{sql}"


def with_more(ctes: str, sql: str) -> str:
    return f"WITH RECURSIVE devices AS MATERIALIZED ({devices_sql('duckdb')}),\nlinks AS MATERIALIZED ({links_sql('duckdb')}),\n{ctes}\n{sql}"
