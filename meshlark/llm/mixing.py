"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output over what it
has.  A hash of the seed and the document gives a uniform number; the inverse of the
source's Poisson distribution turns it into the number of copies.  The copies are then
dealt out by another hash, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions

SEED = 20240501
#: A table of rates goes to all tasks if it has at most so many numbers (8 MB); a longer one is joined by shuffle.
SMALL_TABLE = 1 << 20
#: Default weights: sizes to this power, so that small sources are repeated and large ones thinned.
POWER = 0.5


def uniform(*parts: Column) -> Column:
    """A number in (0, 1), of 52 bits, from the MD5 of the parts' texts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_table(rate: Column) -> Column:
    """The distribution function at 0, 1, ... up to where the rest is below 2 ** -60."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    # the log of each probability: k ln(rate) - rate - ln(k!)
    steps = F.transform(F.sequence(F.lit(1), last), lambda k: F.log(rate) - F.log(k))
    terms = F.aggregate(
        steps,
        F.struct(F.array(F.exp(-rate)).alias("cdf"), (-rate).alias("log"), F.exp(-rate).alias("sum")),
        lambda s, d: F.struct(F.concat(s["cdf"], F.array(s["sum"] + F.exp(s["log"] + d))).alias("cdf"), (s["log"] + d).alias("log"), (s["sum"] + F.exp(s["log"] + d)).alias("sum")),
        lambda s: s["cdf"],
    )
    return F.when(rate > 0, terms).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, power: float = POWER, size: str | None = None, total: float | None = None) -> DataFrame:
    """(source, size, rate, cdf): sizes count rows, or sum the column ``size`` (null as 0).

    ``weights`` (source, weight) are target shares; without it, each source weighs its
    size to ``power``.  Sources it does not name, or names with null or less than
    0, weigh 0 and get no copies.  The output's expected size is ``total``, or the
    input's.  A null source is a source of its own.
    """
    amount = F.sum(F.coalesce(F.col(size).cast("double"), F.lit(0.0))) if size else F.count(F.lit(1)).cast("double")
    sizes = docs.groupBy("source").agg(amount.alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(power)))
    else:
        named = weights.groupBy("source").agg(F.sum("weight").cast("double").alias("weight")).withColumnRenamed("source", "_source")
        sizes = sizes.join(named, sizes["source"].eqNullSafe(named["_source"]), "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    whole = sizes.agg(F.sum("size").alias("all"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("weights"))
    rated = sizes.crossJoin(F.broadcast(whole))  # one row
    rate = F.when((F.col("size") > 0) & (F.col("weights") > 0), F.col("weight") / F.col("weights") * (F.lit(float(total)) if total is not None else F.col("all")) / F.col("size")).otherwise(0.0)
    return rated.withColumn("rate", rate).select("source", "size", "rate", poisson_table(F.col("rate")).alias("cdf"))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = SEED, shuffle: bool = True) -> DataFrame:
    """docs (doc_id, source, ...) -> all its columns, then _copy (from 0) and _key, a row for each copy.

    Columns that are called _copy or _key already are replaced.
    The number of copies depends on the seed and doc_id alone, given the rate; rows
    that repeat an id are repeated alike.  Copies are ordered by _key, a hash of seed,
    id and copy, within and across partitions, so the order is the same however the
    input was laid out.  As keys are uniform, the partition of a key is its share of
    their range: one shuffle, and no pass to sample bounds.  A table of rates beyond
    SMALL_TABLE numbers is not sent to all tasks but joined, where AQE splits hot sources.
    """
    # the row travels as one struct, so that no column of its own can clash with the ones used here
    names = [c for c in docs.columns if c not in ("_copy", "_key")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_from"))
    cdf = cut(rates.select(F.col("source").alias("_source"), F.col("cdf").alias("_cdf")))
    numbers = cdf.agg(F.sum(F.size("_cdf") + 1).alias("n")).first()["n"] or 0
    rows = rows.join(F.broadcast(cdf) if numbers <= SMALL_TABLE else cdf, rows["_from"].eqNullSafe(cdf["_source"]))
    u = uniform(F.lit(seed), F.lit("copies"), F.col("_id"))
    rows = rows.withColumn("_u", u).withColumn("_n", F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))).where("_n > 0")
    rows = rows.select("_row", "_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_copy"))
    rows = rows.select(*[F.col("_row")[c].alias(c) for c in names], "_copy", F.xxhash64(F.lit(seed), "_id", "_copy").alias("_key"))
    return _in_key_order(rows, partitions(docs)) if shuffle else rows


def _in_key_order(rows: DataFrame, parts: int) -> DataFrame:
    place = F.floor((F.col("_key").cast("double") / float(1 << 64) + 0.5) * parts)
    place = F.greatest(F.least(place, F.lit(parts - 1)), F.lit(0)).cast("int")
    return rows.repartitionById(parts, place).sortWithinPartitions("_key")
