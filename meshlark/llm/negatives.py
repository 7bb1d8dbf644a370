"""Hard negatives by a full sort of each anchor's scores.

Vectors become integers, so that scores and their order are exact.  Rows are dealt out
into groups of bounded size; anchors pass by each group as a stream.  In a first pass
every group offers an anchor its best rows of the same label, which gives the positives.
In a second pass a group sorts the anchor's scores against all its rows of other labels
by score and id, searches each positive's upper limit and reads on from there down
to the lower one; the groups' findings are ranked at last.  No task holds more than a
group of rows and a few anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, store

UNIT = 256
#: Bytes of 8-byte components in a group of rows, fewest rows that make a group, and scores held at once.
GROUP_BYTES, LEAST_ROWS, SCORES = 32 << 20, 1024, 1 << 21
LONG_MAX = (1 << 63) - 1


def _padded(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists -> floor(256 x) as doubles, a row for each; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy()
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * UNIT)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = at < width  # what the other side has no component for adds nothing
    out[row[keep], at[keep]] = values[keep]
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles while these hold them, else in Python's integers, cut to 64 bits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 53:
        return (a @ b.T).astype(np.int64)
    big = np.dot(np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape), np.array([[int(x) for x in r] for r in b], dtype=object).reshape(b.shape).T)
    return np.array([[min(max(int(x), -LONG_MAX), LONG_MAX) for x in r] for r in big], dtype=np.int64).reshape(len(a), len(b))


class Group:
    """Rows of a group, sorted by label and id."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        column = lambda name: pa.concat_arrays([b.column(name) for b in batches])
        label, ids, row = (column(x).to_numpy() for x in ("label", "id", "row"))
        order = np.lexsort((row, ids, label))
        self.label, self.ids, self.row = label[order], ids[order], row[order]
        self.vectors = _padded(column("vector"))[order]

    def of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]).tolist())


def _grouped(batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (g, anchor): collects the rows of a group, then hands its anchors to ``answer``."""
    rows: list[pa.RecordBatch] = []
    now, group = None, None
    for batch in batches:
        g, anchor = batch.column("g").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False).astype(np.int8)
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(g) != 0) | (np.diff(anchor) != 0), [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if g[a] != now:
                now, rows, group = g[a], [], None
            if not anchor[a]:
                rows.append(part)
                continue
            if group is None and rows:
                group, rows = Group(rows), []
            if group is None:
                continue  # a group without rows has nothing to offer
            step = max(1, SCORES // max(1, len(group.ids)))
            for i in range(0, part.num_rows, step):
                found = answer(group, part.slice(i, step))
                if found is not None:
                    yield found


def _by_label(group: Group, anchors: pa.RecordBatch):
    """For each label among the anchors: the label, the anchors' places and vectors."""
    label = anchors.column("label").to_numpy()
    vectors = _padded(anchors.column("vector"), group.vectors.shape[1])
    for value in np.unique(label).tolist():
        at = np.flatnonzero(label == value)
        yield value, at.tolist(), vectors[at]


def _positives(k: int):
    def answer(group: Group, anchors: pa.RecordBatch):
        own = anchors.column("row").to_numpy()
        out: list[list[np.ndarray]] = []
        for label, at, vectors in _by_label(group, anchors):
            same = group.of(label)
            ids, rows = group.ids[same], group.row[same]
            if not len(ids):
                continue
            for i, score in zip(at, scores(vectors, group.vectors[same]), strict=True):
                order = np.lexsort((rows, ids, -score))[: k + 1]
                order = order[rows[order] != own[i]][:k]
                out.append([np.full(len(order), own[i]), rows[order], ids[order], score[order]])
        if out:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["row", "p_row", "p_id", "p_score"])

    return lambda batches: _grouped(batches, answer)


def _negatives(k: int, lower: int, upper: int):
    def answer(group: Group, anchors: pa.RecordBatch):
        own, limits = anchors.column("row").to_numpy(), anchors.column("positives")
        out: list[list[np.ndarray]] = []
        for label, at, vectors in _by_label(group, anchors):
            same = group.of(label)
            other = np.concatenate([np.arange(same.start), np.arange(same.stop, len(group.ids))])
            ids, rows, facing = group.ids[other], group.row[other], group.vectors[other]
            if not len(ids):
                continue
            for i, score in zip(at, scores(vectors, facing), strict=True):
                order = np.lexsort((rows, ids, -score))
                falling = -score[order]
                for p in limits[i].as_py():
                    # 100 n <= upper p and 100 n >= lower p, in whole numbers
                    most, least = upper * p["p_score"] // 100, -(-lower * p["p_score"] // 100)
                    if least > most or most < -LONG_MAX or least > LONG_MAX:
                        continue
                    a = int(np.searchsorted(falling, -min(most, LONG_MAX), side="left"))
                    b = min(a + k, int(np.searchsorted(falling, -max(least, -LONG_MAX), side="right")))
                    if a < b:
                        take = order[a:b]
                        out.append([np.full(b - a, x) for x in (own[i], p["p_row"], p["p_id"], p["p_score"])] + [rows[take], ids[take], score[take]])
        if out:
            names = ["row", "p_row", "positive_id", "positive_score", "n_row", "negative_id", "negative_score"]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=names)

    return lambda batches: _grouped(batches, answer)


def _meet(rows: DataFrame, anchors: DataFrame, groups: int, extra: str) -> DataFrame:
    """Rows dealt out into groups, and each group's copy of the anchors, sorted so that rows come first."""
    dealt = rows.select(F.pmod("row", F.lit(groups)).cast("int").alias("g"), F.lit(False).alias("anchor"), "row", "id", "label", "vector", F.lit(None).cast(extra).alias("positives"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("anchor"), "row", "id", "label", "vector", "positives")
    parts = min(groups, partitions(rows))
    return dealt.unionByName(sent).repartitionById(parts, F.pmod("g", F.lit(parts))).sortWithinPartitions("g", "anchor")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95) -> DataFrame:
    """vectors (id, label, vector, ...) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows for which ``anchor`` (a condition on id, label, vector) holds are the anchors.
    An anchor's positives are the ``positives`` best other rows of its label; for each, the
    ``negatives`` best rows of other labels with a score from ``lower`` to ``upper`` per
    cent of the positive's are returned.  The score is the inner product of floor(256 x);
    equal scores go by ascending id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no
    part.  Rows that repeat an id, or all of a row, are rows of their own: another copy of
    an anchor may be its positive, and each copy is an anchor itself.  Of two vectors of
    different lengths the shorter ends in zeros.  Scores beyond 64 bits are cut to them.
    An empty table gives an empty one; other columns are ignored.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where("id is not null and label is not null and vector is not null").where(finite)
    # stored, as rows are told apart by their place
    rows = store(rows.withColumn("vector", F.col("vector").cast(vectors.schema["vector"].dataType)).withColumn("row", F.monotonically_increasing_id()))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.size("vector") + 4)).first()
    n, size = n or 0, (size or 0) * 8
    groups = max(1, -(-size // GROUP_BYTES), min(partitions(rows), -(-n // LEAST_ROWS)))
    anchors = rows.where(anchor)
    kind = "array<struct<p_row: long, p_id: long, p_score: long>>"
    offered = _meet(rows, anchors.withColumn("positives", F.lit(None).cast(kind)), groups, kind).mapInArrow(_positives(positives), "row long, p_row long, p_id long, p_score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("p_score"), "p_id", "p_row"))
    chosen = offered.withColumn("_rank", rank).where(F.col("_rank") <= positives).groupBy("row").agg(F.collect_list(F.struct("p_row", "p_id", "p_score")).alias("positives"))
    limited = cut(anchors.join(chosen, "row"))
    schema = "row long, p_row long, positive_id long, positive_score long, n_row long, negative_id long, negative_score long"
    found = _meet(rows, limited, groups, kind).mapInArrow(_negatives(negatives, lower, upper), schema)
    rank = F.row_number().over(Window.partitionBy("row", "p_row").orderBy(F.desc("negative_score"), "negative_id", "n_row"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = limited.select("row", F.col("id").alias("anchor_id"))
    return found.join(named, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
