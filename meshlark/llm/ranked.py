"""Ranked lexical search as a blocked sparse matrix product (row merging after Gustavson, 1978).

The item-term matrix holds multiplicities, the term-document matrix 64-bit impacts.
One sweep of the corpus stores the term-document counts of a block of items' terms;
totals and document frequencies come from that table.  A second pass multiplies: for
each block of documents, an item's row is the merged sum of its terms' rows, and a task
keeps each item's best.  Tasks' best are reduced in two steps, so no task meets a row of
every task of a large corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, store

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
K1_UNIT, LENGTH_SHARE, SCALE = 1000, 25, 1_000_000_000
#: Bytes of item texts that one sweep of the corpus answers, and so about the most that a task is sent.
ITEM_BYTES = 4 << 20
#: Documents in a block of the product.
BLOCK = 4096
#: Bytes of text taken apart at once.
PIECE = 1 << 20
#: Parts in which tasks' best meet before the last step.
PARTS = 64


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a text that no term crosses."""
    at = 0
    while len(text) - at > PIECE:
        gap = GAP.search(text, at + PIECE)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    for piece in _pieces(text):
        yield TERM.findall(piece.lower())  # of bytes: A-Z only


def _counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n, terms, tfs): all of a document's terms counted, those of the vocabulary listed."""

    def run(batches):
        for batch in batches:
            ids, lengths, sizes, found, tfs = [], [], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.large_binary())):
                n, seen = 0, Counter()
                for words in terms(text.as_py() or b""):
                    n += len(words)
                    seen.update(map(vocabulary.get, words))
                if n:
                    seen.pop(None, None)
                    ids.append(row)
                    lengths.append(n)
                    sizes.append(len(seen))
                    found.extend(seen.keys())
                    tfs.extend(seen.values())
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((found, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def impacts(tfs: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L, in 64-bit integers."""
    if LENGTH_SHARE * int(lengths.max(initial=0)) * documents < 1 << 63:
        share = LENGTH_SHARE * lengths * documents // total
    else:  # the product alone needs more bits than its quotient
        share = np.array([LENGTH_SHARE * int(n) * documents // total for n in lengths], dtype=np.int64)
    return SCALE * tfs // (K1_UNIT * tfs + 12 * (100 - LENGTH_SHARE + share))


class Best:
    """The best rows of each item so far: score descending, id ascending, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * items
        self.ids = [np.zeros(0, np.int64)] * items
        self.nulls = [np.zeros(0, bool)] * items
        self.least = np.ones(items, dtype=np.int64)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        s, i, n = (np.concatenate(x) for x in ((self.scores[item], scores), (self.ids[item], ids), (self.nulls[item], nulls)))
        order = np.lexsort((i, n, -s))[: self.k]
        self.scores[item], self.ids[item], self.nulls[item] = s[order], i[order], n[order]
        if len(order) == self.k:
            self.least[item] = s[order[-1]]


def _multiply(matrix: list[list[tuple[int, int]]], weights: np.ndarray, documents: int, total: int, k: int):
    def run(batches):
        best = Best(len(matrix), k)
        for batch in batches:
            ids = batch.column(0)
            nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            lengths = batch.column(1).to_numpy()
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            for a in range(0, len(ids), BLOCK):
                b = min(a + BLOCK, len(ids))
                owner = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                t, c = term[ends[a] : ends[b]], tf[ends[a] : ends[b]]
                value = weights[t] * impacts(c, lengths[a:b][owner], documents, total)
                order = np.argsort(t, kind="stable")
                owner, value = owner[order], value[order]
                edge = np.searchsorted(t[order], np.arange(len(weights) + 1)).tolist()
                row = np.zeros(b - a, dtype=np.int64)
                for item, factors in enumerate(matrix):
                    row[:] = 0
                    for x, times in factors:
                        s, e = edge[x], edge[x + 1]
                        if s < e:
                            row[owner[s:e]] += times * value[s:e]  # a document occurs once in a term's row
                    at = np.flatnonzero(row >= best.least[item])
                    if len(at):
                        best.add(item, row[at], ids[a:b][at], nulls[a:b][at])
        sizes = [len(s) for s in best.scores]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(matrix)), sizes), pa.int32()), pa.array(np.concatenate(best.ids), pa.int64(), mask=np.concatenate(best.nulls)), pa.array(np.concatenate(best.scores), pa.int64())],
                names=["item", "doc_id", "score"],
            )

    return run


def _sweep(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """Answers one block of items (item_id, text); None if they or the documents hold no term."""
    counted = [Counter(w for words in terms((r["text"] or "").encode("utf-8", "surrogatepass")) for w in words) for r in items]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counted)))}
    if not vocabulary:
        return None
    table = store(_counts(docs, vocabulary))
    documents, total = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    held = table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # a row for each term of the block of items
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for r in held:
        weights[r["t"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
    matrix = [[(vocabulary[w], n) for w, n in sorted(c.items()) if weights[vocabulary[w]] > 0] for c in counted]
    found = table.where(F.size("terms") > 0).mapInArrow(_multiply(matrix, weights, documents, total, k), "item int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    found = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).withColumn("_rank", rank("item", "_part")).where(F.col("_rank") <= k)
    found = found.withColumn("rank", rank("item")).where(F.col("rank") <= k)
    names = F.array(*[F.lit(r["item_id"]).cast("long") for r in items]) if len(items) <= 10_000 else None
    if names is not None:
        return found.select(F.element_at(names, F.col("item") + 1).alias("item_id"), "rank", "doc_id", "score")
    named = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item int, item_id long")
    return found.join(named, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) -> (item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    A row of docs is a document, repeated rows too; rows of items that repeat id and
    text are one item, those that repeat an id alone are items of their own, each
    ranked from 1.  Null and blank texts have no terms: such documents count
    nowhere, such items return nothing.  Equal scores go by ascending doc_id, null ids
    last.  Texts of any length are taken apart in pieces.  An empty table on either side
    gives an empty one; other columns are ignored.

    Items go in blocks of about ``ITEM_BYTES``, each of which sweeps the corpus once.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # of about ITEM_BYTES
        found = _sweep(docs, part, k)
        if found is not None:
            out = out.unionByName(cut(found) if blocks > 1 else found) if block else found
    return out
