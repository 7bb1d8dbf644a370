"""Exact removal of repeated word windows, by super-k-mer partitioning.

Every window of ``width`` words has a minimiser: the least hash among its runs of
``mmer`` words.  Consecutive windows with one minimiser form a super-k-mer and
travel as one packed string to the minimiser's bucket; equal windows have equal
minimisers, so they meet there, where sorting the windows' hashes brings them
together.  Each match is then checked word by word, so no hash decides a result.

* Hot minimisers: a first pass over all rows finds the runs that are the minimiser
  of a share of windows (HOT); they rank behind all others in a second pass, so
  windows around a frequent line go by their other runs.  The share is at most a
  quarter of a partition's, so no run outweighs one; the list has at most 2 / HOT
  entries, or 8 a partition, whatever the input.
* Passages in which every run is hot go window by window, each to the bucket of its own
  hash, so that they are spread over as many buckets as they have windows.
* Hot windows: each map batch sends only its first copy of a window and reports
  its other copies itself, so a passage in a third of all documents reaches its
  bucket once for each batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, chunks, cut, mix, partitions, prefix_hash, span_hash, text_buffer, word_spans

HOT = 1 / 2000
#: Bytes of text whose copies of a window a map task compares before it sends anything.
BLOCK_BYTES = 6 << 20
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
TOP = np.uint64(1 << 63)
VALUES = byte_values(20)
#: What a blob holds for each super-k-mer: document id, text hash, whether the id is null, first word, bytes.
HEAD = (("doc", "<i8"), ("hash", "<i8"), ("null", "u1"), ("start", "<i4"), ("size", "<i4"))
SCHEMA = "bucket int, blob binary, doc_id long, h long, starts array<int>, counts array<int>"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, first word of each row, and hashes of the words."""
    starts, ends, rows = word_spans(data, offsets)
    prefix = prefix_hash(VALUES[data[int(offsets[0]) : int(offsets[-1])]])
    return starts, ends, rows, mix(span_hash(prefix, starts, ends))


def _runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words; runs at the end that are too short are left out."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    prefix = prefix_hash(hashes)
    i = np.arange(len(hashes) - length + 1)
    return mix(span_hash(prefix, i, i + length))


def _fits(rows: np.ndarray, n: int, length: int) -> np.ndarray:
    """For each of n words, whether a run of ``length`` words of its own row starts there."""
    ends = np.repeat(rows[1:], np.diff(rows))
    return np.arange(n) + length <= ends


def _minimisers(hashes: np.ndarray, rows: np.ndarray, width: int, mmer: int, hot: np.ndarray) -> np.ndarray:
    """The least run hash of the window at each word; meaningless where no window fits."""
    n = len(hashes)
    keys = np.full(n, LAST)
    keys[: max(0, n - mmer + 1)] = _runs(hashes, mmer) >> np.uint64(1)
    if len(hot):
        at = np.searchsorted(hot, keys)
        keys = np.where(hot[np.minimum(at, len(hot) - 1)] == keys, keys | TOP, keys)
    keys[~_fits(rows, n, mmer)] = LAST
    span, least = width - mmer + 1, keys
    step = 1
    while step < span:
        by = min(step, span - step)
        least = np.minimum(least, np.concatenate([least[by:], np.full(min(by, n), LAST)])[:n])
        step += by
    return least


def hot_minimisers(docs: DataFrame, width: int, mmer: int, share: float = HOT) -> np.ndarray:
    """Runs that are the minimiser of at least ``share`` of all windows; at most 2 / share of them, sorted.

    A run with that share overall has half of it or more in tasks where its own
    share is half of it or more, so tasks need to report only those.
    """

    def run(batches):
        seen: dict[int, int] = {}
        total = 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b in chunks(offsets):
                _, _, rows, hashes = _words(data, offsets[a : b + 1])
                least = _minimisers(hashes, rows, width, mmer, np.zeros(0, np.uint64))[_fits(rows, len(hashes), width)]
                total += len(least)
                values, counts = np.unique(least, return_counts=True)
                many = counts > 1
                for v, c in zip(values[many].tolist(), counts[many].tolist(), strict=True):
                    seen[v] = seen.get(v, 0) + c
                if len(seen) > 200_000:  # a lossy count: what falls below an eighth of the share so far can't matter
                    seen = {v: c for v, c in seen.items() if c >= total * share / 8}
        out = [(v, c) for v, c in seen.items() if c >= total * share / 4]
        out.append((-1, total))
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64())], names=["key", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.where("key = -1").first()
    if not total or not total["n"]:
        return np.zeros(0, np.uint64)
    rows = counts.where((F.col("key") >= 0) & (F.col("n") >= F.lit(total["n"] * share / 2))).select("key").collect()
    return np.sort(np.array([r["key"] for r in rows], dtype=np.uint64))


def _by_bucket(bucket: np.ndarray, parts: int):
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(parts + 1))
    return ((p, order[edge[p] : edge[p + 1]]) for p in range(parts) if edge[p] < edge[p + 1])


def _repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash occurs at an earlier position, and for each the first such."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    first = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    again = ~fresh
    return order[again], first[again]


def _checked(later: np.ndarray, first: np.ndarray, hashes: np.ndarray, words_of, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keeps what is equal word by word; where a hash lied, pairs the true copies."""
    if not len(later):
        return later, first
    order = np.argsort(later)
    later, first = later[order], first[order]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(later) != 1) | (np.diff(first) != 1), [True]]))
    lies = [(a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if words_of(later[a], b - a + width - 1) != words_of(first[a], b - a + width - 1)]
    if not lies:
        return later, first
    keep = np.ones(len(later), dtype=bool)
    extra = []
    wrong = {int(hashes[later[i]]) for a, b in lies for i in range(a, b)}
    for value in wrong:
        keep &= hashes[later] != np.uint64(value)
        seen: dict[tuple, int] = {}
        for at in np.flatnonzero(hashes == np.uint64(value)).tolist():
            text = tuple(words_of(at, width))
            if text in seen:
                extra.append((at, seen[text]))
            else:
                seen[text] = at
    later = np.concatenate([later[keep], np.array([x for x, _ in extra], dtype=later.dtype)])
    first = np.concatenate([first[keep], np.array([x for _, x in extra], dtype=first.dtype)])
    order = np.argsort(later)
    return later[order], first[order]


def _hits(buckets: np.ndarray, doc: np.ndarray, null: np.ndarray, text_hash: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Windows to remove, as runs of consecutive starts; a row for each run of windows of one document."""
    same = (doc[1:] == doc[:-1]) & (text_hash[1:] == text_hash[:-1]) & (null[1:] == null[:-1])
    edge = np.flatnonzero(np.concatenate([[True], ~same | (np.diff(start) != 1), [True]]))
    runs, counts = edge[:-1], np.diff(edge)
    rows = np.flatnonzero(np.concatenate([[True], ~same[runs[1:] - 1], [True]])) if len(runs) else np.zeros(1, np.int64)
    at = runs[rows[:-1]] if len(runs) else runs
    lists = lambda x: pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(x, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(buckets[at], pa.int32()),
            pa.nulls(len(at), pa.binary()),
            pa.array(doc[at], pa.int64(), mask=null[at].astype(bool)),
            pa.array(text_hash[at], pa.int64()),
            lists(start[runs]),
            lists(counts),
        ],
        names=["bucket", "blob", "doc_id", "h", "starts", "counts"],
    )


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    empty = pa.ListArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), pa.array([], pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), empty, empty],
        names=["bucket", "blob", "doc_id", "h", "starts", "counts"],
    )


def _map_side(width: int, mmer: int, parts: int, hot: np.ndarray):
    """(doc_id, h, text) -> blobs of super-k-mers by bucket, and hits of copies within a batch."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0)
            null = np.asarray(ids.is_null()).astype(np.uint8)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            text_hash = batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column(2))
            for a, b in chunks(offsets, BLOCK_BYTES):
                order = a + np.lexsort((text_hash[a:b], doc[a:b], null[a:b]))
                texts = [data[offsets[i] : offsets[i + 1]] for i in order.tolist()]
                ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                yield from _pack_block(np.concatenate(texts), ends, doc[order], null[order], text_hash[order], width, mmer, parts, hot, pack)

    return run


def _pack_block(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, null: np.ndarray, text_hash: np.ndarray, width: int, mmer: int, parts: int, hot: np.ndarray, pack):
    """Hits and blobs of a block of rows, which are in the order of their documents."""
    windows, where = [], []
    for a, b in chunks(offsets):
        base = int(offsets[a])
        starts, ends, rows, hashes = _words(data, offsets[a : b + 1])
        fits = np.flatnonzero(_fits(rows, len(hashes), width))
        if not len(fits):
            continue
        row = np.searchsorted(rows, fits, side="right") - 1
        least = _minimisers(hashes, rows, width, mmer, hot)[fits]
        own = _runs(hashes, width)[fits]
        least = np.where(least >= TOP, own | TOP, least)  # every run is hot
        windows.append(own)
        where.append((base + starts[fits], base + ends[fits + width - 1], (a + row).astype(np.int32), (fits - rows[row]).astype(np.int32), least))
    if not windows:
        return
    window = np.concatenate(windows)
    begin, end, row, start, least = (np.concatenate(x) for x in zip(*where, strict=True))
    del windows, where
    raw = data.tobytes()
    later, first = _checked(*_repeats(window), window, lambda at, n: raw[begin[at] : end[at + n - width]].split(), width)
    own = (doc[row[later]] == doc[row[first]]) & (text_hash[row[later]] == text_hash[row[first]]) & (null[row[later]] == null[row[first]]) & (start[later] == start[first])
    again = later[~own]  # a repeated row is not a copy of itself
    fresh = np.ones(len(window), dtype=bool)
    fresh[later] = False
    if len(again):
        r = row[again]
        yield _hits((doc[r] % parts).astype(np.int32), doc[r], null[r], text_hash[r], start[again])
    at = np.flatnonzero(fresh)
    if not len(at):
        return
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]]) | (start[at[1:]] - start[at[:-1]] != 1) | (least[at[1:]] != least[at[:-1]]), [True]]))
    i, j = at[edge[:-1]], at[edge[1:] - 1]
    head = [doc[row[i]], text_hash[row[i]], null[row[i]], start[i], end[j] - begin[i]]
    ready, size = [], 0
    for p, members in _by_bucket((mix(least[i]) % np.uint64(parts)).astype(np.int32), parts):
        body = b"".join([raw[x:y] for x, y in zip(begin[i[members]].tolist(), end[j[members]].tolist(), strict=True)])
        columns = (np.diff(c[members].astype(kind), prepend=c.dtype.type(0)).astype(kind).tobytes() for c, (_, kind) in zip(head, HEAD, strict=True))
        blob = pack.compress(b"".join([len(members).to_bytes(8, "little"), *columns, body]))
        ready.append((p, blob))
        size += len(blob)
        if size > 4 << 20:
            yield _blobs(ready)
            ready, size = [], 0
    if ready:
        yield _blobs(ready)


def _count_bucket(blobs: list[bytes], width: int, bucket: int):
    """The hits among the super-k-mers of one bucket."""
    unpack = zstandard.ZstdDecompressor()
    columns: list[list] = [[] for _ in HEAD]
    bodies = []
    for blob in blobs:
        raw = unpack.decompress(blob)
        n, at = int.from_bytes(raw[:8], "little"), 8
        for column, (_, kind) in zip(columns, HEAD, strict=True):
            column.append(np.cumsum(np.frombuffer(raw, kind, n, at), dtype=kind))
            at += n * np.dtype(kind).itemsize
        bodies.append(raw[at:])
    head, body = {name: np.concatenate(c) for (name, _), c in zip(HEAD, columns, strict=True)}, b"".join(bodies)
    del columns, bodies
    at = np.concatenate([[0], np.cumsum(head["size"], dtype=np.int64)])
    order = np.lexsort((head["start"], head["hash"], head["doc"], head["null"]))
    data = np.frombuffer(body, dtype=np.uint8)
    windows, begins, ends, owners, firsts = [], [], [], [], []
    for a, b in chunks(at):
        starts, stops, rows, hashes = _words(data, at[a : b + 1])
        fits = np.flatnonzero(_fits(rows, len(hashes), width))
        row = np.searchsorted(rows, fits, side="right") - 1
        windows.append(_runs(hashes, width)[fits])
        begins.append(at[a] + starts[fits])
        ends.append(at[a] + stops[fits + width - 1])
        owners.append((a + row).astype(np.int32))
        firsts.append((fits - rows[row]).astype(np.int32))
    window, begin, end, owner, offset = (np.concatenate(x) for x in (windows, begins, ends, owners, firsts))
    # windows in the order of their place: by super-k-mer, then by start
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    line = np.argsort(rank[owner], kind="stable")
    window, begin, end, owner, offset = window[line], begin[line], end[line], owner[line], offset[line]
    later, first = _repeats(window)
    if not len(later):
        return None
    later, first = _checked(later, first, window, lambda k, n: body[begin[k] : end[k + n - width]].split(), width)
    x, y = ({k: c[owner[at]] for k, c in head.items()} for at in (later, first))
    start, start_first = x["start"] + offset[later], y["start"] + offset[first]
    other = (x["doc"] != y["doc"]) | (x["hash"] != y["hash"]) | (x["null"] != y["null"]) | (start != start_first)
    if not other.any():
        return None
    x = {k: c[other] for k, c in x.items()}
    return _hits(np.full(other.sum(), bucket, np.int32), x["doc"], x["null"], x["hash"], start[other])


def _reduce_side(width: int):
    """Blobs sorted by bucket -> hits; hits of the map side pass through."""

    def run(batches):
        bucket, blobs = None, []
        for batch in batches:
            found = batch.filter(batch.column(1).is_null())
            if found.num_rows:
                yield found
            batch = batch.filter(batch.column(1).is_valid())
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and blobs:
                    out = _count_bucket(blobs, width, bucket)
                    if out is not None:
                        yield out
                    blobs = []
                bucket = b
                blobs.append(blob)
        if blobs:
            out = _count_bucket(blobs, width, bucket)
            if out is not None:
                yield out

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): h tells rows of equal id apart; it is 0 throughout where no id repeats, as it costs bytes."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    unique = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    h = F.lit(0).cast("long") if unique else F.xxhash64("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), F.col("text").cast("string").alias("text"))


def repeated_windows(docs: DataFrame, width: int = 20, mmer: int = 5, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, h, starts, counts): windows that also start earlier, as runs of starts.

    Earlier means a smaller doc_id (null ids come last; equal ids go by the hash h
    of their text, which is 0 where no id repeats), or the same document and an earlier start.  Rows that repeat
    both id and text are one document.  A document may have several rows.
    """
    return _repeated(_keyed(docs), width, mmer, buckets)


def _repeated(keyed: DataFrame, width: int, mmer: int, buckets: int | None) -> DataFrame:
    rows = keyed.where("text is not null")
    parts = partitions(keyed)
    buckets = buckets or parts * max(2, -(-256 // parts))  # as many in each partition
    hot = hot_minimisers(rows, width, mmer, min(HOT, 1 / (4 * parts)))
    packed = rows.mapInArrow(_map_side(width, mmer, buckets, hot), SCHEMA)
    return packed.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket").mapInArrow(_reduce_side(width), SCHEMA).select("doc_id", "h", "starts", "counts")


def remove_repeats(docs: DataFrame, width: int = 20, mmer: int = 5, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_words, n_removed, kept, kept_sha256), a row for each row.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged.  Each word
    that a repeated window covers is removed; windows are judged on the input.
    Kept words are joined by one space (``kept`` is null unless ``keep_text``).  A
    null or blank text, or one shorter than a window, loses nothing.  Other columns
    are ignored.
    """
    rows = _keyed(docs)
    hits = _repeated(rows, width, mmer, None).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("counts")).alias("counts"))
    hits = hits.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "starts", "counts")
    joined = rows.join(hits.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(hits["_d"]) & (rows["h"] == hits["_h"]), "left").select("doc_id", "text", "starts", "counts")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            n_words, n_removed, kept, digests = [], [], [], []
            for text, starts, counts in zip(texts, batch.column(2), batch.column(3), strict=True):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                if starts.is_valid:
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    a, n = starts.values.to_numpy(), counts.values.to_numpy()
                    np.add.at(gone, a, 1)
                    np.add.at(gone, a + n + width - 1, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    n_removed.append(int(len(words) - stay.sum()))
                    words = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
                else:
                    n_removed.append(0)
                whole = b" ".join(words)
                digests.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole.decode("utf-8", "replace") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
