"""MinHash near-duplicates: one permutation, optimal densification, bands, stars, exact confirmation.

* One permutation hashing (Li, Owen, Zhang, 2012) cuts the hash range into bins; the least
  hash of each bin is its value.  An empty bin takes the value of a filled one by its own
  fixed random order of all bins (optimal densification, Shrivastava, 2017), so short
  texts have signatures as good as long ones.
* Sets that agree on a band of bins share a bucket.  A bucket sends star-shaped edges:
  each member is compared with the bucket's hub, the member that meets most others over
  all its buckets.  In a crowd of near copies that is the text they were made from.
* Stars alone could lose a link between two members that both differ from the hub.
  Buckets whose members are not yet in one component are therefore compared whole, in cells
  of bounded size: the product of a cell's set-shingle matrix with itself gives all
  intersections, and only a spanning star of each component leaves the cell.  Members most
  of whose shingles no other candidate has are left out before, as they can reach no one.
* A link counts only if the full sets of 64-bit shingle hashes confirm it.

Equal sets are one node from the start.  Two sets whose similarity is the threshold
share no bucket with odds (1 - 0.85 ** ROWS) ** BANDS, that is 2e-7; more similar ones with less.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW_BYTES, byte_values, chunks, cut, mix, partitions, prefix_hash, span_hash, store, text_buffer, word_spans
from .graph import components, stars

SHINGLE, BANDS, ROWS = 3, 40, 7
BINS = BANDS * ROWS
#: Members and shingles of a cell in which all sets are compared, members that make a shingle frequent there, and columns multiplied at once.
CELL_ROWS, CELL_SHINGLES, FEW, COLUMNS = 512, 1 << 20, 6, 2048
#: Bytes of one text that are taken apart at once, and most bits of the filter that finds texts again.
PIECE, FILTER_BITS = 4 << 20, 28
VALUES = byte_values(11)
FACTORS = np.random.default_rng(12).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: For each bin, all bins in its own random order.
ORDER = np.random.default_rng(13).random((BINS, BINS)).argsort(axis=1)
SKETCH = "doc_id long, n long, s1 long, s2 long, bands array<long>"


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets)
    prefix = prefix_hash(VALUES[data[int(offsets[0]) : int(offsets[-1])]])
    return mix(span_hash(prefix, starts, ends) + (ends - starts).astype(np.uint64)), first


def _long_word_hashes(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text, cut at white space into pieces."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] != 0x20 and not 0x09 <= data[end] <= 0x0D:
            end += 1
        out.append(_word_hashes(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and each text's first word -> shingle hashes, distinct and sorted within each text, and the number of each text."""
    n, lengths = len(words), np.diff(first)
    h = np.full(n, k, dtype=np.uint64)
    for i in range(min(k, n)):
        h[: n - i] += words[i:] * FACTORS[i]
    fits = np.arange(n) + k <= np.repeat(first[1:], lengths)
    for i in np.flatnonzero((lengths > 0) & (lengths < k)).tolist():  # all words are one shingle
        a, b = first[i], first[i + 1]
        h[a] = (words[a:b] * FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        fits[a] = True
    h, owner = mix(h[fits]), np.repeat(np.arange(len(lengths)), lengths)[fits]
    edge = np.searchsorted(owner, np.arange(len(lengths) + 1)).tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        h[a:b].sort()
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[: len(h)]
    h, owner = h[fresh], owner[fresh]
    return h, np.bincount(owner, minlength=len(lengths))


def word_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of texts: the first one's place, the hashes of all words, and each text's first word.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D.
    """
    data, offsets = text_buffer(texts)
    for a, b in chunks(offsets, NARROW_BYTES):
        block = LOWER[data[offsets[a] : offsets[b]]]
        if len(block) > PIECE:  # one text alone
            words = _long_word_hashes(block)
            yield a, words, np.array([0, len(words)])
        else:
            yield a, *_word_hashes(block, offsets[a : b + 1] - offsets[a])


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of texts: the first one's place, their shingle sets one after the other, and the sets' sizes."""
    for a, words, first in word_blocks(texts):
        yield a, *shingles(words, first, k)


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One value for each bin of each set; of an empty set, nothing that means anything."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bins = (((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)  # grows with the hash
    cell = owner * BINS + bins
    least = np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)]
    out, filled = np.zeros(len(sizes) * BINS, dtype=np.uint64), np.zeros(len(sizes) * BINS, dtype=bool)
    out[cell[least]] = hashes[least]
    filled[cell[least]] = True
    empty = np.flatnonzero(~filled & np.repeat(sizes > 0, BINS))
    start, own = empty // BINS * BINS, empty % BINS
    for place in range(BINS):
        if not len(empty):
            break
        other = start + ORDER[own, place]
        found = filled[other]
        out[empty[found]] = out[other[found]]
        empty, start, own = empty[~found], start[~found], own[~found]
    return out.reshape(-1, BINS)


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = (values.reshape(-1, BANDS, ROWS) * FACTORS[:ROWS]).sum(axis=2, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * FACTORS[ROWS]).view(np.int64)


def set_keys(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set; 0 for an empty one."""
    out = np.zeros((2, len(sizes)), dtype=np.uint64)
    some = sizes > 0
    if some.any():
        start = (np.cumsum(sizes) - sizes)[some]
        for i, h in enumerate((mix(hashes), mix(hashes * FACTORS[8] + FACTORS[9]))):
            out[i, some] = np.add.reduceat(h, start)
    return out[0].view(np.int64), out[1].view(np.int64)


def sketches(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n, s1, s2, bands), a row for each row; bands is null for an empty set."""

    def run(batches):
        for batch in batches:
            for a, hashes, sizes in shingle_sets(batch.column(1), k):
                some = sizes > 0
                flat = band_keys(signatures(hashes, sizes))[some].ravel()
                ends = np.concatenate([[0], np.cumsum(some * BANDS)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()), mask=pa.array(~some))
                columns = [pa.array(x, pa.int64()) for x in (sizes, *set_keys(hashes, sizes))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sizes)), *columns, lists], names=["doc_id", "n", "s1", "s2", "bands"])

    return docs.mapInArrow(run, SKETCH)


def _places(doc: np.ndarray, one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
    h = mix(doc.view(np.uint64) * FACTORS[10] + one.view(np.uint64)) ^ two.view(np.uint64)
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def _filter(nodes: DataFrame, bits: int) -> bytes:
    """A bitmap of 2 ** bits bits of the nodes' (first, s1, s2): its size is bounded whatever their number."""

    def run(batches):
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for batch in batches:
            at = _places(*(batch.column(i).fill_null(0).to_numpy() for i in range(3)), bits)
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        i = np.flatnonzero(words)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(words[i].view(np.int64))], names=["i", "w"])

    rows = nodes.select("first", "s1", "s2").mapInArrow(run, "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[rows.column("i").to_numpy()] = rows.column("w").to_numpy().view(np.uint64)
    return out.tobytes()


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """nodes (node, first, n, s1, s2) -> (node, hashes: binary): their sets, made again from the texts of their first documents."""
    n = nodes.count()
    bits = min(FILTER_BITS, max(16, (16 * n).bit_length()))
    wanted = _filter(nodes, bits)

    def run(batches):
        words = np.frombuffer(wanted, dtype=np.uint64)
        for batch in batches:
            doc, seen = batch.column(0).fill_null(0).to_numpy(), set()
            for a, hashes, sizes in shingle_sets(batch.column(1), k):
                one, two = set_keys(hashes, sizes)
                at = _places(doc[a : a + len(sizes)], one, two, bits)
                held = np.flatnonzero((words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool) & (sizes > 0))
                ends = np.cumsum(sizes)
                fresh = [i for i in held.tolist() if (key := (one[i], two[i])) not in seen and not seen.add(key)]
                if fresh:
                    found = [hashes[ends[i] - sizes[i] : ends[i]].tobytes() for i in fresh]
                    yield pa.RecordBatch.from_arrays([pa.array(one[fresh]), pa.array(two[fresh]), pa.array(found, pa.binary())], names=["s1", "s2", "hashes"])

    made = docs.mapInArrow(run, "s1 long, s2 long, hashes binary")
    made = made.join(nodes.select("node", "s1", "s2"), ["s1", "s2"]).select("node", "hashes")
    return made.dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """pairs (a, b) -> those whose sets have 100 * intersection >= share * union."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")

    def run(batches):
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (xs, ys))
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= share * (len(x) + len(y) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in range(2)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _own(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, own): how many of a node's shingles occur in no other of these nodes, so that it shares them with none."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = np.frombuffer(batch.column(1)[i].as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), batch.column(0)[i].as_py())), pa.array(hashes)], names=["node", "h"])

    each = sets.join(nodes, "node", "left_semi").select("node", "hashes").mapInArrow(run, "node long, h long")
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _sized(rows: DataFrame) -> DataFrame:
    """rows (key, node, ...) -> those whose key has another, with the number c of the key's rows."""
    return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "key")


def _unsettled(crowd: DataFrame, linked: DataFrame | None) -> DataFrame:
    """The members of buckets that hold more than one component."""
    rooted = crowd.withColumn("root", F.col("node")) if linked is None else crowd.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spread = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return crowd.join(spread, "key", "left_semi")


def _cells(rows: DataFrame) -> DataFrame:
    """rows (key, node, n) -> (cell, side, node): buckets as cells; a large one is cut into parts, and a cell holds two of them.

    Buckets of the same members are one.  ``side`` is 0 in a cell of one part, else 1 or 2.
    """
    shape = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
    parts = F.greatest(F.ceil(F.col("c") / CELL_ROWS), F.ceil(F.col("size") / CELL_SHINGLES)).cast("int")
    one = shape.where("c > 1").groupBy("c", "size", "who").agg(F.min("key").alias("key")).select("key", parts.alias("g"))
    mine = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("g") - 1),
        lambda j: F.struct(F.least(mine, j).alias("lo"), F.greatest(mine, j).alias("hi"), F.when(mine == j, 0).when(mine < j, 1).otherwise(2).cast("byte").alias("side")),
    )
    return rows.join(one, "key").select("node", "key", F.explode(cells).alias("x")).select(F.xxhash64("key", "x.lo", "x.hi").alias("cell"), "x.side", "node")


def shared_counts(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, given one after the other: exact, a product of the set-shingle matrix with itself.

    Shingles of few sets add to their pairs one by one, those of many by blocks of columns.
    """
    m = len(sizes)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(hashes, kind="stable")
    ranked, owner = hashes[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
    times = np.diff(edge)
    out = np.zeros(m * m, dtype=np.int64)
    for d in range(2, min(FEW, m) + 1):
        rows = owner[edge[:-1][times == d][:, None] + np.arange(d)]  # in ascending order, as the sort is stable
        for i, j in itertools.combinations(range(d), 2):
            if len(rows) > m:
                out += np.bincount(rows[:, i] * m + rows[:, j], minlength=m * m)
            elif len(rows):
                np.add.at(out, rows[:, i] * m + rows[:, j], 1)
    out = out.reshape(m, m)
    out += out.T
    many = np.flatnonzero(times > FEW)
    for a in range(0, len(many), COLUMNS):
        some = many[a : a + COLUMNS]
        block = np.zeros((m, len(some)), dtype=np.float32)
        at = np.repeat(edge[some] - np.concatenate([[0], np.cumsum(times[some])[:-1]]), times[some]) + np.arange(times[some].sum())
        block[owner[at], np.repeat(np.arange(len(some)), times[some])] = 1
        out += (block @ block.T).astype(np.int64)
    return out


def _link_cell(node: np.ndarray, side: np.ndarray, sets: list[np.ndarray], share: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a cell, as stars: they connect just what the sets' similarity connects."""
    sizes = np.array([len(x) for x in sets])
    shared = shared_counts(sizes, np.concatenate(sets))
    near = 100 * shared >= share * (sizes[:, None] + sizes[None, :] - shared)
    if side.any():
        near &= side[:, None] != side[None, :]
    return stars(node, *np.nonzero(np.triu(near, 1)))


def _compared(rows: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """rows (key, node, n) -> links (a, b) between members of a key whose sets reach the share."""

    def links_of(cell: list[pa.RecordBatch]):
        column = lambda name: pa.concat_arrays([b.column(name) for b in cell])
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in column("hashes")]
        a, b = _link_cell(column("node").to_numpy(), column("side").to_numpy(), sets, share)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        now, kept = None, []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])).tolist()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if kept and cell[a] != now:
                    yield links_of(kept)
                    kept = []
                now = cell[a]
                kept.append(batch.slice(a, b - a))
        if kept:
            yield links_of(kept)

    dealt = _cells(rows).join(sets, "node").select("cell", "side", "node", "hashes")
    return dealt.repartition(partitions(rows), "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def banded(nodes: DataFrame) -> DataFrame:
    """nodes (node, n, bands, ...) -> (key, node, n): the buckets of each."""
    return nodes.select("node", "n", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("key"), "node", "n")


def links(docs: DataFrame, nodes: DataFrame, keyed: DataFrame, share: int = 85, k: int = SHINGLE) -> DataFrame:
    """nodes (node, first, n, s1, s2, ...), distinct sets, and keyed (key, node, n), their buckets -> (node, root: long) of the nodes with a link.

    All pairs that share a bucket are compared, as far as a link between them could matter.
    """
    crowd = _sized(keyed)
    crowd = cut(crowd.join(crowd.groupBy("node").agg(F.sum("c").alias("w")), "node"))
    star = crowd.join(crowd.groupBy("key").agg(F.max(F.struct("w", (-F.col("node")).alias("minus"), "n")).alias("hub")), "key")
    star = star.select("node", "n", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("m"))
    star = star.where((F.col("node") != F.col("hub")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * share))
    pairs = cut(star.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    none = docs.sparkSession.createDataFrame([], "node long, root long")
    if crowd.isEmpty():
        return none
    sets = store(_sets(docs, nodes.join(crowd.select("node").distinct(), "node", "left_semi"), k))
    found = cut(_confirm(pairs, sets, share))
    linked = None if found.isEmpty() else cut(components(found))
    left = cut(_unsettled(crowd.select("key", "node", "n"), linked))
    # what no other text has is shared with none, which rules out most texts that only resemble each other
    left = left.join(_own(sets, left.select("node").distinct()), "node", "left").where((F.col("n") - F.coalesce("own", F.lit(0))) * 100 >= F.col("n") * share)
    more = cut(_compared(cut(_unsettled(left.select("key", "node", "n"), linked)), sets, share))
    if not more.isEmpty():
        # the classes found so far are stars already, so few rounds are left
        known = found if linked is None else linked.select(F.col("node").alias("a"), F.col("root").alias("b"))
        linked = cut(components(known.unionByName(more)))
    return none if linked is None else linked


def near_classes(docs: DataFrame, share: int = 85, k: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), a row for each row.

    Texts whose shingle sets have 100 * intersection >= share * union are linked;
    component_id is the smallest doc_id reachable, itself included, and ``kept`` says
    whether that is the row's own.  A null, empty or blank text has an empty set and is
    linked with nothing, not even its like.  Rows that repeat an id are judged by their
    texts, and each that has the component's smallest id is kept.  Null ids are larger
    than any id; a component of null ids alone gets null, and all its rows are kept.
    Texts of any length count whole.  An empty table gives an empty one; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = store(sketches(docs, k))
    key = ["n", "s1", "s2"]
    some = rows.where("n > 0")
    nodes = store(some.groupBy(*key).agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    linked = links(docs, nodes, banded(nodes), share, k)
    named = nodes.select("node", *key, "first").join(linked, "node")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(least, "root").select(*key, "least")
    single = nodes.select("node", *key, "first").join(linked, "node", "left_anti").select(*key, F.col("first").alias("least"))
    classes = named.unionByName(single)
    out = some.select("doc_id", *key).join(classes, key).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
