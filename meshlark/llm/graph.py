"""Connected components by alternating stars (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def stars(nodes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component, and that least one: at most a link for each node."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``links`` (a, b: long) -> (node, root: long), root the smallest node reachable.

    Only nodes that occur in a link are returned, a root among them.  Self-links
    and nulls are ignored; repeated links count once; an empty table gives an
    empty table.  Each round is two grouped minima, joined back: work is linear in
    the links, a hub's links are pre-aggregated, and AQE may split the join of a
    hub.  Raises RuntimeError if ``rounds`` do not reach the fixed point, rather
    than returning parts of components.
    """
    edges = cut(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        # both directions by explode: a union would double the tasks of every stage that reads them
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        edges = cut(small.select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        was, mark = mark, _mark(edges)
        if was == mark:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
