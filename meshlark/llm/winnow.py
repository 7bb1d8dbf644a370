"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Rolling hashes of all k-grams of code points; of every ``window`` consecutive ones the
least is kept, the rightmost if it occurs more than once, with its position.  Any two
texts that share window + k - 1 code points or more share a mark within them.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mix, partitions, prefix_hash, span_hash, text_buffer

K = WINDOW = 24
#: A key is 40 bits of hash above 24 bits of reversed place; a longer text goes piece by piece.
PLACE_BITS = 24
PIECE = 1 << 20
#: Bytes of text handled at once; a code point takes some 100 bytes while its text is worked on.
BLOCK_BYTES = 1 << 19
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SALT = np.uint64(0xA0761D6478BD642F)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _gram_keys(codes: np.ndarray, k: int) -> np.ndarray:
    """For each k-gram its hash (high 40 bits) over its place counted from the end (low 24 bits)."""
    n = len(codes) - k + 1
    prefix = prefix_hash(mix(codes.astype(np.uint64) + SALT))
    i = np.arange(n)
    hashes = mix(span_hash(prefix, i, i + k))
    return (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | (np.uint64((1 << PLACE_BITS) - 1) - i.astype(np.uint64))


def _sliding_min(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of keys[i:i + window] for each i where it fits."""
    span, out = 1, keys
    while span < window:
        by = min(span, window - span)
        out = np.minimum(out[: len(out) - by], out[by:])
        span += by
    return out


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.uint64((1 << PLACE_BITS) - 1) - (keys & np.uint64((1 << PLACE_BITS) - 1))
    return keys >> np.uint64(PLACE_BITS), place.astype(np.int64)


def _piece_marks(codes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) < k:  # one gram: the whole text
        k = len(codes)
    keys = _gram_keys(codes, k)
    least = _sliding_min(keys, min(window, len(keys)))
    # the chosen place never moves left, so repeats are neighbours
    return _split(least[np.concatenate([[True], least[1:] != least[:-1]])])


def marks(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's marks, by position.

    An empty text has none; one shorter than k has its whole as the only gram; one
    with fewer grams than ``window`` has the least of them.
    """
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) <= PIECE:
        return _piece_marks(codes, k, window)
    found = []
    for a in range(0, len(codes) - (k + window - 2), PIECE):  # pieces overlap by all but one place of a window
        h, p = _piece_marks(codes[a : a + PIECE + k + window - 2], k, window)
        found.append((h, p + a))
    h, p = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    p, first = np.unique(p, return_index=True)
    return h[first], p


def batch_marks(texts: list[np.ndarray], k: int = K, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """``marks`` of many short texts at once; needs k >= window, so that no window spans two texts' grams."""
    sizes = np.array([len(t) for t in texts])
    if k < window or sizes.sum() + k >= 1 << PLACE_BITS:
        return [marks(t, k, window) for t in texts]
    whole = np.concatenate([*texts, np.zeros(k + window, np.uint32)])
    base = np.concatenate([[0], np.cumsum(sizes)])
    keys = _gram_keys(whole, k)
    long = sizes >= k
    grams = np.zeros(len(keys), dtype=bool)
    edge = np.zeros(len(keys) + 1, dtype=np.int32)
    np.add.at(edge, base[:-1][long], 1)
    np.add.at(edge, base[:-1][long] + (sizes[long] - k + 1), -1)
    grams = np.cumsum(edge[:-1]) > 0
    keys[~grams] = NONE
    least = _sliding_min(np.concatenate([keys, np.full(window, NONE)]), window)
    out = []
    for i, t in enumerate(texts):
        if not long[i]:
            out.append(marks(t, k, window))
            continue
        n = max(1, len(t) - k + 1 - window + 1)
        own = least[base[i] : base[i] + n]
        h, p = _split(own[np.concatenate([[True], own[1:] != own[:-1]])])
        out.append((h, p - base[i]))
    return out


def digest(mark: tuple[np.ndarray, np.ndarray]) -> str:
    """32 hex digits that stand for the marks and their positions."""
    return hashlib.blake2b(mark[0].astype("<u8").tobytes() + mark[1].astype("<i8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of mark hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, hashes: array<long>, positions: array<long>), a row for each row.

    A null text counts as empty and has no marks; equal texts have equal marks;
    repeated rows each get theirs; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = [_codes(t or "") for t in batch.column(1).to_pylist()]
            found = [marks(t, k, window) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))], names=["doc_id", "hashes", "positions"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


FIELDS = (
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("mark_hashes", pa.list_(pa.int64())), ("mark_positions", pa.list_(pa.int32())),
)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, mark_hashes array<long>, mark_positions array<int>"
#: Rows looked at for each bound between two partitions.
LOOKS = 60


def _rows(ids: list, texts: list[str], k: int, window: int) -> list[tuple]:
    """Result rows of all texts but the last, each with the one after it as its next."""
    codes = [_codes(t) for t in texts]
    found = batch_marks(codes, k, window)
    tails, tail_from = [], []
    for own, after in zip(codes[:-1], codes[1:], strict=True):
        n, keep = len(own), len(own) - len(own) // 3
        a = max(0, keep - (k + window - 2))  # windows wholly before keep are as in the text itself
        tails.append(np.concatenate([own[a:keep], after[: n // 3]]))
        tail_from.append(a)
    ends = batch_marks(tails, k, window)
    out = []
    for i, own in enumerate(codes[:-1]):
        n, keep, a = len(own), len(own) - len(own) // 3, tail_from[i]
        edited = texts[i][:keep] + texts[i + 1][: n // 3]
        if a:
            # the text's windows that end before keep start up to a - 1; they chose the marks up to that last one's
            h, p = found[i]
            near = np.arange(np.searchsorted(p, a - 1), np.searchsorted(p, a - 1 + window))
            last = near[len(near) - 1 - np.argmin(h[near][::-1])]
            h, p = h[: last + 1], p[: last + 1]
            if len(tails[i]) >= k + window - 1:  # else no window reaches past keep
                h, p = np.concatenate([h, ends[i][0]]), np.concatenate([p, ends[i][1] + a])
            p, first = np.unique(p, return_index=True)
            change = (h[first], p)
        else:
            change = ends[i]
        out.append((ids[i], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(found[i]), digest(change), likeness(found[i][0], change[0]), likeness(found[i][0], found[i + 1][0]), found[i][0].astype(np.int64), found[i][1].astype(np.int32)))
    return out


KEY = "struct<none: int, id: bigint, hash: bigint>"


def _bounds(keys: DataFrame, n: int, parts: int) -> list[tuple]:
    """``parts - 1`` keys that cut the rows into parts of about equal counts."""
    if n <= 1 or parts <= 1:
        return []
    looked = sorted(tuple(r["k"]) for r in keys.sample(min(1.0, LOOKS * parts / n), seed=1).collect())
    return [looked[len(looked) * i // parts] for i in range(1, parts)] if looked else []


def _literal(keys: list, kind: str):
    return F.from_json(F.lit(json.dumps(keys)), kind)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows (doc_id, text) in order in ``parts`` partitions, the first row of each also as the last of the one before it (``guard``).

    The order is cut at bounds from a look at some keys; a binary search in them gives a
    row's place.  The first rows' keys, one for each part, come from the light keys alone.
    """
    key = F.struct(F.col("doc_id").isNull().cast("int").alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("id"), F.xxhash64("text").alias("hash"))
    keys = cut(rows.select(key.alias("k")))
    n = keys.count()
    bounds = _bounds(keys, n, parts)
    named = lambda k: dict(zip(("none", "id", "hash"), k, strict=True))
    table = _literal([named(k) for k in bounds], f"array<{KEY}>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))]) if bounds else F.array().cast("array<int>")
    place = lambda k: F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= k, at + step).otherwise(at))
    heads = {r["place"]: tuple(r["k"]) for r in keys.select(place(F.col("k")).alias("place"), "k").groupBy("place").agg(F.min("k").alias("k")).collect()}
    filled = sorted(heads)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}
    firsts = _literal([{"k": named(heads[p]), "before": before[p]} if p in heads else None for p in range(parts)], f"array<struct<k: {KEY}, before: int>>")
    placed = rows.withColumn("k", key).withColumn("place", place(F.col("k"))).withColumn("first", F.get(firsts, F.col("place")))
    goes = lambda p, guard: F.struct(p.alias("place"), F.lit(guard).alias("guard"))
    own = goes(F.col("place"), False)
    twice = placed.withColumn("to", F.explode(F.when(F.col("k") == F.col("first.k"), F.array(own, goes(F.col("first.before"), True))).otherwise(F.array(own))))
    order = ["guard", F.col("doc_id").desc_nulls_last(), "hash", "text"]
    return twice.select("doc_id", "text", F.col("k.hash").alias("hash"), "to.place", "to.guard").repartitionById(parts, "place").sortWithinPartitions(*order).select("doc_id", "text", "guard")


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) -> RESULT: each text's fingerprint against its edited text's and its successor's, and the marks themselves.

    The order is by descending doc_id (null ids last, equal ids by the hash of their
    text); after the last comes the first.  The edited text has its last
    floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    text.  ``fingerprint`` stands for the marks and positions that ``mark_hashes`` and
    ``mark_positions`` list; likeness is Jaccard's over mark hashes.  A null text counts
    as empty, has no marks and is like any other empty text.
    A single row is its own successor.  Other columns are ignored.

    One shuffle of the texts into ranges; each task streams its range, whose last row
    finds its successor right behind it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        last, done = None, False
        for batch in batches:
            if done:  # further guards
                continue
            data, offsets = text_buffer(batch.column(1))
            every, guards = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in chunks(offsets, BLOCK_BYTES):
                own = b if not any(guards[a:b]) else a + guards[a:b].index(True) + 1  # one guard is enough
                ids = every[a:own]
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(a, own)]
                if last is not None:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                if len(ids) > 1:
                    columns = zip(*_rows(ids, texts, k, window), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)], names=[f for f, _ in FIELDS])
                if guards[own - 1]:
                    done = True
                    break
                last = (ids[-1], texts[-1])

    return _dealt(rows, partitions(docs)).mapInArrow(run, RESULT)
