"""Helpers shared by the corpus operators: lineage cuts, chunking, byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step works on at once, unless one text alone is longer.
CHUNK_BYTES = 1 << 21
#: The same where many arrays as long as the text are alive together.
NARROW_BYTES = 1 << 20
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _folder(df: DataFrame) -> str:
    """The shared checkpoint folder: the one named in ``spark.checkpoint.dir``; where that is unset, a new one, but only in local mode (tests)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="meshlark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` (light rows) in the shared checkpoint folder and forget its lineage."""
    _folder(df)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table: for rows that carry texts."""
    path = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounded_rank(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Adds ``name``: the gapless rank from 0 within ``keys``, by bucket, then by ``order``.

    A plain window over ``keys`` would put all rows of a key into one task.  Here
    the window runs within (keys, bucket) and the offset of each bucket is a
    running sum over the small table of bucket counts, so a key's rows are
    spread over as many tasks as it has buckets.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1)
    return (
        ranked.join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_rank") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_rank", "_offset")
    )


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads a polynomial hash over all bits."""
    h = (h ^ (h >> np.uint64(33))) * MIX_1
    h = (h ^ (h >> np.uint64(33))) * MIX_2
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            more = min(k, max(n - k, k >> 3))  # a worker keeps them, so not many more than asked for
            self.up = np.concatenate([self.up, self.up[:more] * np.uint64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down[:more] * np.uint64(pow(BASE_INVERSE, k, 1 << 64))])


POWERS = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of values[j] * BASE**j for j < i, modulo 2**64."""
    POWERS.need(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * POWERS.up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of values[start:end]."""
    return (prefix[end] - prefix[start]) * POWERS.down[start]


def byte_values(seed: int = 7) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null as empty) and the n + 1 offsets into them."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most ``limit`` bytes each, or of a single longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row its first word's index (n + 1 entries).

    ``data`` holds the rows from offsets[0] to offsets[-1]; positions count from
    offsets[0].  A word never crosses a row.
    """
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    inside = ~separators[data[base : base + size]]
    edge = np.zeros(size + 1, dtype=bool)
    rows = offsets - base
    edge[rows] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:size]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:size]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, rows)
