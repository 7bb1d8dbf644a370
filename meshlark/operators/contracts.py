"""Invariants of topologies that the library itself makes: ids, references and address arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ipv6
from ..sources.detections import number


def short_ids(ids: DataFrame) -> DataFrame:
    """ids (image_id, id) -> adds short: ``device_001`` as ``device_1``, unless any two of the image would collide."""
    short = F.when(F.col("id").rlike(r"^[A-Za-z]+_[0-9]+$"), F.concat(F.regexp_extract("id", r"^([A-Za-z]+)_", 1), F.lit("_"), F.regexp_extract("id", r"_([0-9]+)$", 1).try_cast("bigint").cast("string"))).otherwise(F.col("id"))
    rows = ids.withColumn("_s", short)
    # an image collides if one short form stands for two ids; an id has one short form, so this sees all, without an image's ids in one place
    forms = rows.where("id is not null").groupBy("image_id", "_s").agg((F.min("id") != F.max("id")).alias("_two"))
    clash = forms.where("_two").select(F.col("image_id").alias("_image")).distinct()
    found = rows.join(clash, F.col("image_id").eqNullSafe(F.col("_image")), "left_anti").withColumn("short", F.col("_s"))
    kept = rows.join(clash, F.col("image_id").eqNullSafe(F.col("_image")), "left_semi").withColumn("short", F.col("id"))
    return found.unionByName(kept).drop("_s")


def mirror(addresses: DataFrame) -> DataFrame:
    """addresses (image_id, device_id, ip, prefix, mask, network, version, suffix) -> one row a device and family: its one address, or nulls if it has several.

    Entries with an address or mask count before bare suffixes.
    """
    solid = F.col("ip").isNotNull() | F.col("mask").isNotNull()
    entry = F.struct("ip", "prefix", "mask", "network", "suffix")
    both = addresses.groupBy("image_id", "device_id", "version").agg(F.collect_list(F.when(solid, entry)).alias("real"), F.collect_list(entry).alias("every"))
    chosen = F.when(F.size("real") > 0, F.col("real")).otherwise(F.col("every"))
    one = F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0)))
    return both.select("image_id", "device_id", "version", one["ip"].alias("ip"), one["prefix"].alias("prefix"), one["mask"].alias("mask"), one["network"].alias("network"), one["suffix"].alias("suffix"))


def reference_problems(devices: DataFrame, links: DataFrame) -> DataFrame:
    """devices (image_id, device_id), links (image_id, link_id, source, target) -> (image_id, id, problem): repeated ids, unknown ends, links to themselves."""
    ids = devices.select("image_id", F.col("device_id").alias("id")).unionByName(links.select("image_id", F.col("link_id").alias("id")))
    twice = ids.groupBy("image_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("image_id", "id", F.lit("duplicate_id").alias("problem"))
    ends = links.select("image_id", F.col("link_id").alias("id"), F.explode(F.array("source", "target")).alias("device_id")).where("device_id is not null")
    lost = ends.join(devices.select("image_id", "device_id"), ["image_id", "device_id"], "left_anti").select("image_id", "id", F.lit("unknown_device").alias("problem"))
    loops = links.where("source = target").select("image_id", F.col("link_id").alias("id"), F.lit("self_link").alias("problem"))
    none = links.where("source is null").select("image_id", F.col("link_id").alias("id"), F.lit("missing_source").alias("problem"))
    return twice.unionByName(lost).unionByName(loops).unionByName(none)


def block_problem(ip: Column, prefix: Column, mask: Column, network: Column, version: Column, prefix_mask: Column) -> Column:
    """What is inconsistent about an address block, or NULL: prefix range, mask, base, family."""
    base = ipv6.network_of(F.coalesce(ip, network), prefix)
    six = version == 6
    return (
        F.when(prefix.isNotNull() & ~prefix.between(0, F.when(six, 128).otherwise(32)), "prefix_out_of_range")
        .when(six & mask.isNotNull(), "mask_on_ipv6")
        .when(~six & mask.isNotNull() & ~mask.eqNullSafe(prefix_mask), "mask_does_not_match_prefix")
        .when(network.isNotNull() & prefix.isNull(), "network_without_prefix")
        .when(network.isNotNull() & (base != network), "network_does_not_match_address")
    )


__all__ = ["block_problem", "mirror", "number", "reference_problems", "short_ids"]
