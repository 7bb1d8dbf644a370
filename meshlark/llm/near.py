"""Near-duplicate texts: SimHash finds candidates, their shingle sets decide.

One SimHash over five-word shingles cannot find a similarity of 0.8: such texts differ in ten
of its 64 bits.  They share nearly all of their words, though.  So each text gets several
SimHash fingerprints of its distinct words, under different seeds, and a pair is a candidate
if any of them is within the radius; the generalised pigeonhole probes all seeds at once.
Classes of near fingerprints are the buckets in which whole sets of five-word shingles are
compared, by stars and cells, so a candidate that is not near is let go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import minhash, simhash
from .common import cut, mix, store

SHINGLE, SHARE = 5, 80
#: Fingerprints of a text, and bits in which one of two texts' may differ.
SEEDS, RADIUS = 6, 3
KEY = ("n", "s1", "s2")


def fingerprints(hashes: np.ndarray, sizes: np.ndarray, seeds: int = SEEDS) -> np.ndarray:
    """SimHash fingerprints (sets x seeds) of sets given one after the other; 0 of an empty one."""
    out = np.zeros((len(sizes), seeds), dtype=np.int64)
    some = np.flatnonzero(sizes > 0)
    if not len(some):
        return out
    start = (np.cumsum(sizes) - sizes)[some]
    for seed in range(seeds):
        h = mix(hashes * minhash.FACTORS[20 + seed] + np.uint64(seed))
        counts = np.zeros((len(some), 64), dtype=np.int32)
        for a in range(0, len(some), 512):  # bits of a block of texts at once
            lo, hi = start[a], start[a + 512] if a + 512 < len(some) else len(h)
            bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[a : a + 512] = np.add.reduceat(bits, start[a : a + 512] - lo, axis=0, dtype=np.int32)
        out[some, seed] = np.packbits(counts * 2 > sizes[some, None], axis=1, bitorder="little").view(np.int64)[:, 0]
    return out


def sketches(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n, s1, s2, fps): the size and 128 bits of the set of k-word shingles, and the fingerprints of the words."""

    def run(batches):
        for batch in batches:
            for a, words, first in minhash.word_blocks(batch.column(1)):
                hashes, sizes = minhash.shingles(words, first, k)
                fps = fingerprints(*minhash.shingles(words, first, 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * SEEDS, pa.int32()), pa.array(fps.ravel()))
                columns = [pa.array(x, pa.int64()) for x in (sizes, *minhash.set_keys(hashes, sizes))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sizes)), *columns, lists], names=["doc_id", *KEY, "fps"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, fps array<long>")


def with_keys(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs (text, ...) -> the same rows with _n, _s1, _s2: for rows that no id tells apart."""

    def run(batches):
        for batch in batches:
            n, one, two = ([] for _ in range(3))
            for _, hashes, sizes in minhash.shingle_sets(batch.column(batch.schema.names.index("text")), k):
                n.append(sizes)
                for out, x in zip((one, two), minhash.set_keys(hashes, sizes), strict=True):
                    out.append(x)
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (n, one, two)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_n", "_s1", "_s2"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(f"_{c}", T.LongType()) for c in KEY)]))


def similar_classes(docs: DataFrame, k: int = SHINGLE, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> rows (doc_id, n, s1, s2) and, of each class of near texts, the set that stands for it: (n, s1, s2, least).

    ``least`` is the smallest doc_id of the class, null if it has none, and the set is one that
    this id has.  Texts are of one class if links of the share connect them; texts
    without words have equal, empty sets, which are a class of their own.
    """
    rows = store(sketches(docs, k))
    nodes = rows.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.first("fps").alias("fps")).withColumn("node", F.monotonically_increasing_id())
    nodes = store(nodes)
    some = nodes.where("n > 0")
    marks = some.select("node", "n", F.explode(F.array_distinct("fps")).alias("fp"))
    classes = simhash.fingerprint_classes(marks.select("fp", F.col("node").alias("doc_id")), RADIUS)
    # read four times below, each time with all joins of the classes if it were not cut
    keyed = cut(marks.join(classes.select("fp", F.col("root").alias("key")), "fp").select("key", "node", "n").distinct())
    linked = minhash.links(docs, some, keyed, share, k)
    grouped = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # ids before none; of sets with the same least id any will do, so the least node
    order = F.struct(F.col("first").isNull().alias("no"), "first", "node")
    kept = grouped.groupBy("root").agg(F.min_by(F.struct(*KEY, "first"), order).alias("k")).select(*(F.col(f"k.{c}").alias(c) for c in KEY), F.col("k.first").alias("least"))
    return rows.select("doc_id", *KEY), kept


def keep_one(docs: DataFrame, columns: list[str], k: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """docs (doc_id, text, ...) -> one row of each class of near texts: that of the smallest id, null ids last; of rows that repeat it, one.

    Each row is judged by its own text, whatever other rows share its id.
    """
    rows, kept = similar_classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), k, share)
    kept = store(kept.withColumn("_kept", F.lit(True)))
    marked = rows.join(kept, list(KEY), "left").withColumn("_stays", F.col("_kept").isNotNull() & F.col("doc_id").eqNullSafe(F.col("least")))
    ids = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"), F.count_if("_stays").alias("_stay"))
    # ids of one row stay or go; rows of other ids, and those without one, are told apart by their sets
    ids = store(ids.where("doc_id is null or _stay = 0 or _rows > 1").withColumnRenamed("doc_id", "_id"))
    docs = docs.select(*columns)
    alone = docs.join(ids, docs["doc_id"] == ids["_id"], "left_anti").where("doc_id is not null")
    several = ids.where("_stay > 0").select("_id")
    if several.isEmpty():
        return alone
    loose = with_keys(docs.join(several, docs["doc_id"].eqNullSafe(several["_id"]), "left_semi"), k)
    key = [F.col(f"_{c}") == F.col(c) for c in KEY]
    loose = loose.join(kept, key[0] & key[1] & key[2] & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    loose = loose.groupBy("doc_id", *(f"_{c}" for c in KEY)).agg(F.min(F.struct(*(c for c in columns if c != "doc_id"))).alias("_row"))
    return alone.unionByName(loose.select("doc_id", "_row.*"))
