"""SimHash near-duplicates by the generalised pigeonhole principle (Qin et al., GPH, 2018).

For bit groups 1..m and thresholds t_1..t_m (each -1 or more) that sum up to
radius - m + 1, two fingerprints within the radius are within t_i in some group i.
Correlated bits share a group; the thresholds come from a dynamic programme over
estimated candidate counts, so a group whose values crowd together gets -1 (not
probed) and a selective one more.  A group with threshold t is probed by masking:
each fingerprint sends one key for every choice of t of the group's bits, blanked
out; two values within t of each other share a key.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mix, partitions
from .graph import components, stars

SEED = 42
#: Rows of one probe key that one task compares; larger ones are dealt out as pairs of parts.
CELL = 1 << 14
#: Relative cost of one row sent and of one pair compared.
ROW_COST, PAIR_COST = 1.0, 0.004


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and splits at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(x) for x in zip(*(words[i : i + n] for i in range(shingle)), strict=True)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 14):
        block = parts[a : a + (1 << 14)]
        hashes = np.fromiter((digest(p, SEED) for p in block), dtype=np.uint64, count=len(block))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fp: long), a row for each row.

    A null or blank text has fingerprint 0; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = [fingerprint(t, shingle) if t else 0 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs (text, ...) -> the same rows with ``_fp``: for rows that no id tells apart."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).cast(pa.binary())
            out = [fingerprint(t, shingle) if t else 0 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "_fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_fp", T.LongType())]))


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints (column fp) with both bits set; [i, i] is bit i's own count."""

    def run(batches):
        total = np.zeros((64, 64), dtype=np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for a in range(0, len(bits), 1 << 16):
                total += (bits[a : a + (1 << 16)].T @ bits[a : a + (1 << 16)]).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(4096), pa.int32()), pa.array(total.ravel())], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,096 at most
    out = np.zeros(4096)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(64, 64)


def bit_groups(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of 64 / m bits, each grown from its seed by the most correlated free bit."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(64)), []
    for g in range(m):
        size = (64 * (g + 1)) // m - (64 * g) // m
        seed = max(free, key=lambda b: (corr[b][free].max(initial=0), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b][group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """costs[i][t + 1]: of threshold t for group i. The cheapest thresholds that sum to radius - m + 1."""
    m, best = len(costs), {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(options, start=-1):
                key, value = used + t, (cost + c, [*chosen, t])
                if key not in step or value < step[key]:
                    step[key] = value
        best = step
    return best[radius - m + 1]


def _value(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masks(bits: list[int], t: int) -> list[int]:
    return [_value([b for b in bits if b not in out]) for out in itertools.combinations(bits, t)] if t >= 0 else []


def plan_probes(fps: DataFrame, n: int, radius: int) -> list[int]:
    """The bit masks to probe, by cost: over group counts m, then thresholds within each m."""
    both = bit_statistics(fps)
    p = np.diag(both) / max(n, 1)
    agree = p**2 + (1 - p) ** 2
    layouts = {m: bit_groups(both, n, m) for m in range(max(1, radius - 1), radius + 2)}
    named = [(m, g, _value(bits)) for m, groups in layouts.items() for g, bits in enumerate(groups)]
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(v)).alias("v")) for i, (_, _, v) in enumerate(named)])).alias("x"))
    pairs = (
        keyed.groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("c")).groupBy("i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    )  # a row for each group
    equal = {named[r["i"]][:2]: r["pairs"] for r in pairs}
    found = []
    for m, groups in layouts.items():
        costs = []
        for g, bits in enumerate(groups):
            options = [0.0]
            odds = [(1 - agree[b]) / max(agree[b], 1e-9) for b in bits]
            near = 1.0
            for t in range(radius - m + 2):
                if t:
                    near += (sum(odds) ** t) / math.factorial(t)
                options.append(n * ROW_COST * math.comb(len(bits), t) + equal.get((m, g), 0.0) * near * PAIR_COST)
            costs.append(options)
        cost, thresholds = allocate(costs, radius)
        found.append((cost, m, [v for bits, t in zip(groups, thresholds, strict=True) for v in _masks(bits, t)]))
    return min(found)[2]


def _compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius, block by block, so that memory stays bounded."""
    left, right, step = [], [], max(1, (1 << 20) // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        if same:
            keep = x + i < y
            x, y = x[keep], y[keep]
        left.append(x + i)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def _link_run(key: np.ndarray, part: np.ndarray, fp: np.ndarray, radius: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key, as stars.

    A row of a dealt-out key says by ``part`` on which side of its cell it stands:
    0 both (an ordinary key, or a cell of one part), 1 left, 2 right.
    """
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(edge)
    xs, ys = [], []
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes[group] <= 64
    for shift in range(1, int(min(64, sizes.max(initial=0)))):
        i = np.flatnonzero((group[:-shift] == group[shift:]) & small[shift:])
        if not len(i):
            continue
        near = (np.bitwise_count(fp[i] ^ fp[i + shift]) <= radius) & ((part[i] == 0) | (part[i] != part[i + shift]))
        xs.append(i[near])
        ys.append(i[near] + shift)
    for a, n in zip(edge[:-1][sizes > 64], sizes[sizes > 64], strict=True):
        run, side = fp[a : a + n], part[a : a + n]
        if side[0] == 0:
            x, y = _compare(run, run, radius, True)
        else:
            one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
            if not len(one) or not len(two):
                continue
            x, y = _compare(run[one], run[two], radius, False)
            x, y = one[x], two[y]
        # links of a block are many where copies crowd; keep a spanning set of them
        nodes, roots = stars(np.arange(n), x, y)
        xs.append(nodes + a)
        ys.append(roots + a)
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(xs), np.concatenate(ys)
    nodes, rows = np.unique(fp, return_inverse=True)
    return stars(nodes, rows[x], rows[y])


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Distinct fingerprints (column fp) -> (a, b: long): links that connect just what the radius connects.

    Not every pair within the radius is returned, but each is connected through
    returned pairs, all of which are within the radius of each other or joined
    through others that are.  Keys with more than CELL rows are dealt out as pairs
    of parts, so that no task holds a whole crowded key.
    """
    n = fps.count()
    masks = plan_probes(fps, n, radius) if n else [0]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(v)).alias("v")) for i, v in enumerate(masks)])).alias("x")).select(
        F.xxhash64("x.i", "x.v").alias("key"), "fp"
    )
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CELL)
    crowded = cut(crowded.select("key", F.ceil(F.col("c") / CELL).cast("int").alias("g")))
    zero = F.lit(0).cast("byte").alias("part")
    if crowded.isEmpty():
        rows = keyed.select("key", zero, "fp")
    else:
        marked = keyed.join(crowded, "key", "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        cells = F.transform(
            F.sequence(F.lit(0), F.col("g") - 1),
            lambda j: F.struct(F.least(mine, j).alias("lo"), F.greatest(mine, j).alias("hi"), F.when(mine == j, 0).when(mine < j, 1).otherwise(2).cast("byte").alias("part")),
        )
        dealt = marked.where("g is not null").select("key", "fp", F.explode(cells).alias("c")).select(F.xxhash64("key", "c.lo", "c.hi").alias("key"), "c.part", "fp")
        rows = marked.where("g is null").select("key", zero, "fp").unionByName(dealt)

    def run(batches):
        kept: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            last = np.searchsorted(now[0], now[0][-1], side="left") if len(now[0]) else 0
            kept = [x[last:] for x in now]
            if last:
                a, b = _link_run(*[x[:last] for x in now], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if kept is not None and len(kept[0]):
            a, b = _link_run(*kept, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition(partitions(fps), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def fingerprint_classes(rows: DataFrame, radius: int = 3) -> DataFrame:
    """rows (doc_id, fp) -> (fp, root, component_id: long), a row for each fingerprint.

    ``root`` is the smallest fingerprint of the class and ``component_id`` its
    smallest doc_id, null if it has null ids alone.
    """
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = cut(components(near_links(distinct, radius)))
    joined = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # only fingerprints with a link need another look; all others are classes by themselves
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return joined.join(least, "root").select("fp", "root", "component_id")


def near_classes(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fp: long, component_id: long), a row for each row.

    Fingerprints at ``radius`` or fewer differing bits are linked; component_id is
    the smallest doc_id reachable, itself included.  Null ids are kept as rows and
    count as larger than any id; a component of null ids alone gets null.  Blank
    and null texts have fingerprint 0, which links like any other.  Equal texts are
    one fingerprint from the start, so a group of copies costs one row.
    """
    rows = cut(fingerprints(docs, shingle))
    return rows.join(fingerprint_classes(rows, radius), "fp").select("doc_id", "fp", "component_id")


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
