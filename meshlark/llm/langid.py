"""Language identification by unigrams whose segmentation is summed out.

A fixed public vocabulary of byte strings serves all languages; each language has its
own piece probabilities.  The probability of a word is the sum over all its
segmentations into pieces, by the forward algorithm; that of a text is the product
over its words.  Words are summed over whole, however long they are: probabilities are
rescaled on the way, and words of more than LONG bytes (scripts without spaces) go by
transfer matrices of STEP bytes, which are found side by side and multiplied in order.
Probabilities are learned by expectation-maximisation (forward and backward passes) from
counts of word parts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NARROW_BYTES, POWERS, byte_values, chunks, mix, prefix_hash, span_hash, text_buffer, word_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes after which probabilities are rescaled, and that one transfer matrix spans.
STEP = 24
#: Words longer than this many bytes go by transfer matrices.
LONG = 1024
#: Labelled rows learned from, for each language, at most; and their word parts, the most frequent ones.
SAMPLE, WORDS = 600, 50_000
#: Words of the sample are learned from in parts of at most so many bytes, cut between code points.
PART = 40
ROUNDS = 4
#: Word scores that a worker remembers, by the top bits of the word's hash.
MEMORY_BITS = 19
VALUES = byte_values(3)
#: Bytes that are no part of a word: all of ASCII but its letters (texts are lower-cased first).
SEPARATORS = np.array([not (97 <= b <= 122 or b >= 128) for b in range(256)])
FIRST = np.uint64(0x2545F4914F6CDD1D)


def _of_letters(body: bytes) -> bool:
    """Whether a piece may occur in lower-cased words: letters, or bytes of a part of a code point."""
    if not body or SEPARATORS[np.frombuffer(body, np.uint8)].any():
        return False
    try:
        text = body.decode()
    except UnicodeDecodeError:
        return True
    return text.isalpha() and text == text.lower()


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces a lower-cased word can be made of: all single bytes, and strings of letters of any length, a space at most in front."""
    out = {bytes([b]) for b in range(256)}
    with open(path, "rb") as file:
        for line in file:
            piece = base64.b64decode(line.split()[0])
            if _of_letters(piece[1:] if piece[:1] == b" " else piece):
                out.add(piece)
    return sorted(out)


class Lookup:
    """From the hash of a byte string to its number in the vocabulary, or -1."""

    BITS = 20

    def __init__(self, pieces: list[bytes]) -> None:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        prefix = prefix_hash(VALUES[data])
        self.sizes = sorted({len(p) for p in pieces})
        self.keys = mix(span_hash(prefix, ends - [len(p) for p in pieces], ends))
        self.tables = []
        left = np.arange(len(pieces))
        while len(left):  # each table holds what the ones before had no room for
            slot = self._slot(self.keys[left], len(self.tables))
            table = np.full(1 << self.BITS, -1, np.int32)
            table[slot[::-1]] = left[::-1]
            self.tables.append(table)
            left = left[table[slot] != left]

    def _slot(self, keys: np.ndarray, t: int) -> np.ndarray:
        return (keys << np.uint64(7 * t)) >> np.uint64(64 - self.BITS)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = self.tables[0][self._slot(keys, 0)]
        miss = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        for t in range(1, len(self.tables)):
            if not len(miss):
                return out
            got = self.tables[t][self._slot(keys[miss], t)]
            out[miss] = got
            miss = miss[(got >= 0) & (self.keys[got] != keys[miss])]
        out[miss] = -1
        return out


def _matches(lookup: Lookup, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """ids[n, k, j]: the piece that ends after byte j + 1 of word n and has lookup.sizes[k] bytes, or -1."""
    width, n = int(sizes.max()), len(starts)
    grid = data[np.minimum(starts[:, None] + np.arange(width), len(data) - 1)]
    prefix = np.zeros((n, width + 1), np.uint64)
    POWERS.need(width + 1)
    np.cumsum(VALUES[grid] * POWERS.up[:width], axis=1, out=prefix[:, 1:])
    fit = [x for x in lookup.sizes if x <= width]
    ids = np.full((n, len(fit), width), -1, np.int32)
    inside = np.arange(width)[None, :] < sizes[:, None]
    for k, size in enumerate(fit):
        keys = mix((prefix[:, size:] - prefix[:, :-size]) * POWERS.down[: width - size + 1])
        ids[:, k, size - 1 :] = np.where(inside[:, size - 1 :], lookup.find(keys.ravel()).reshape(keys.shape), -1)
    return ids


def _forward(ids: np.ndarray, piece_sizes: list[int], table: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """alpha[n, j, language]: the sum over segmentations of the first j bytes, less a log scale of the same shape (None: 0).

    table: V + 1 rows, the last of zeros.
    """
    n, _, width = ids.shape
    alpha = np.zeros((n, width + 1, table.shape[1]))
    alpha[:, 0] = 1
    scale = np.zeros_like(alpha) if width > PART else None
    reach = max(piece_sizes)
    for j in range(width):
        for k, size in enumerate(piece_sizes):
            if size > j + 1:
                break
            own = ids[:, k, j]
            some = np.flatnonzero(own >= 0)
            if len(some):
                alpha[some, j + 1] += alpha[some, j + 1 - size] * table[own[some]]
        if scale is not None:
            scale[:, j + 1] = scale[:, j]
            if (j + 1) % STEP == 0:  # what later sums still look back on
                a = max(0, j + 2 - reach)
                top = alpha[:, a : j + 2].max(axis=1)
                top[top == 0] = 1
                # all of these share one scale: earlier ones were brought to it when it was set
                alpha[:, a : j + 2] /= top[:, None]
                scale[:, a : j + 2] += np.log(top)[:, None]
    return alpha, scale


def _long_words(lookup: Lookup, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, block: int = 512) -> np.ndarray:
    """log P(word | language) of long words (n x languages), by the products of their chunks' transfer matrices.

    A state holds the sums up to the last ``reach`` bytes; the matrix of a chunk says for
    each entry of the state before it what state comes after it.
    """
    reach, n = lookup.sizes[-1], len(starts)
    base = int(starts.min())
    prefix = prefix_hash(VALUES[data[base : int((starts + sizes).max())]])
    starts = starts - base
    per = -(-sizes // STEP)
    word = np.repeat(np.arange(n), per)
    first = starts[word] + STEP * (np.arange(len(word)) - np.repeat(np.cumsum(per) - per, per))
    ends = starts + sizes
    state = np.zeros((n, table.shape[1], reach))
    state[:, :, 0] = 1
    logs = np.zeros((n, table.shape[1]))
    back = np.arange(reach)
    for a in range(0, len(word), block):
        own = word[a : a + block]
        m = len(own)
        at = first[a : a + block, None] + np.arange(STEP)
        inside = at < ends[own][:, None]
        ids = np.full((m, len(lookup.sizes), STEP), -1, np.int32)
        for k, size in enumerate(lookup.sizes):
            ok = inside & (at + 1 - size >= starts[own][:, None])
            i, j = np.nonzero(ok)
            end = at[i, j] + 1
            ids[i, k, j] = lookup.find(mix(span_hash(prefix, end - size, end)))
        steps = inside.sum(axis=1)
        for c in range(table.shape[1]):
            p = table[:, c]
            # slot (j mod reach) holds the sum up to byte j of the chunk; before it, j is negative
            table_of = np.zeros((m, reach, reach))
            table_of[:, back, -back % reach] = 1
            for j in range(STEP):
                new = np.zeros((m, reach))
                for k, size in enumerate(lookup.sizes):
                    weight = p[ids[:, k, j]]
                    if weight.any():
                        new += table_of[:, :, (j + 1 - size) % reach] * weight[:, None]
                live = inside[:, j]
                table_of[live, :, (j + 1) % reach] = new[live]
            order = (steps[:, None] - back) % reach
            table_of = np.take_along_axis(table_of, order[:, None, :], axis=2)
            for i, w in enumerate(own.tolist()):
                after = state[w, c] @ table_of[i]
                top = after.max()
                state[w, c] = after / top
                logs[w, c] += np.log(top)
    return logs + np.log(state[:, :, 0])


def _expected(ids: np.ndarray, piece_sizes: list[int], sizes: np.ndarray, table: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` the expected counts of pieces in the word parts of one language. table, out: V + 1."""
    n, _, width = ids.shape
    alpha = _forward(ids, piece_sizes, table[:, None])[0][:, :, 0]
    beta = np.zeros((n, width + 1))
    rows = np.arange(n)
    beta[rows, sizes] = 1
    for j in range(width - 1, -1, -1):
        for k, size in enumerate(piece_sizes):
            if size > width - j:
                break
            own = ids[:, k, j + size - 1]
            some = np.flatnonzero(own >= 0)
            if len(some):
                beta[some, j] += table[own[some]] * beta[some, j + size]
    total = alpha[rows, sizes]
    for j in range(width):
        for k, size in enumerate(piece_sizes):
            if size > j + 1:
                break
            own = ids[:, k, j]
            some = np.flatnonzero(own >= 0)
            if len(some):
                gain = alpha[some, j + 1 - size] * table[own[some]] * beta[some, j + 1] / total[some] * weight[some]
                np.add.at(out, own[some], gain)


def _grouped(sizes: np.ndarray, cells: int = 1 << 19):
    """Words of similar size together, of at most ``cells`` bytes at once, and whether they are long."""
    order = np.argsort(sizes, kind="stable")
    limits = [8, 12, 16, 24, PART, 64, 128, 256, 512, LONG]
    a = 0
    for limit, b in zip(limits, np.searchsorted(sizes[order], np.array(limits), side="right").tolist(), strict=True):
        step = max(1, cells // limit)
        for i in range(a, b, step):
            yield order[i : min(b, i + step)], False
        a = b
    if a < len(order):
        yield order[a:], True


def _spread(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, one after the other, and the edges between them."""
    return np.frombuffer(b"".join(words) + b" ", np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def parts(word: bytes) -> list[bytes]:
    """A word with the space before it, in parts of at most PART bytes that are cut between code points."""
    out, rest = [], b" " + word
    while len(rest) > PART:
        at = PART
        while at > PART - 4 and rest[at] & 0xC0 == 0x80:
            at -= 1
        out.append(rest[:at])
        rest = rest[at:]
    return [*out, rest]


class Model:
    """Languages and their log piece probabilities."""

    def __init__(self, languages: list[str], pieces: list[bytes], table: np.ndarray) -> None:
        self.languages, self.pieces, self.table = languages, pieces, table
        self.ready = None

    def __getstate__(self):
        return self.languages, self.pieces, self.table.astype(np.float32)

    def __setstate__(self, state):
        self.languages, self.pieces, self.table = state
        self.table = self.table.astype(np.float64)
        self.ready = None

    def prepare(self) -> None:
        if self.ready is None:
            self.lookup = Lookup(self.pieces)
            self.known = np.zeros(1 << MEMORY_BITS, np.uint64)
            self.scores = np.zeros((1 << MEMORY_BITS, len(self.languages)), np.float32)
            self.ready = True

    def words(self, words: list[bytes]) -> np.ndarray:
        """log P(word | language), words x languages."""
        data, edges = _spread([b" " + w for w in words])
        starts, sizes = edges[:-1], np.diff(edges)
        logs = np.zeros((len(sizes), len(self.languages)))
        for some, long in _grouped(sizes):
            if long:
                logs[some] = _long_words(self.lookup, data, starts[some], sizes[some], self.table)
                continue
            alpha, scale = _forward(_matches(self.lookup, data, starts[some], sizes[some]), self.lookup.sizes, self.table)
            last = np.arange(len(some)), sizes[some]
            logs[some] = np.log(alpha[last]) + (scale[last] if scale is not None else 0)
        return logs

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log P(text | language) of lower-cased texts, rows x languages."""
        self.prepare()
        base = int(offsets[0])
        starts, ends, rows = word_spans(data, offsets, SEPARATORS)
        prefix = prefix_hash(VALUES[data[base : int(offsets[-1])]])
        hashes = mix(span_hash(prefix, starts, ends) ^ FIRST)
        slot = hashes >> np.uint64(64 - MEMORY_BITS)
        new = np.flatnonzero(self.known[slot] != hashes)
        own = np.zeros((0, len(self.languages)), np.float32)
        if len(new):
            fresh, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[first]
            raw = data[base : int(offsets[-1])].tobytes()
            own = self.words([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]).astype(np.float32)
        each = self.scores[slot]
        if len(new):
            each[new] = own[which]
            place = fresh >> np.uint64(64 - MEMORY_BITS)
            self.known[place], self.scores[place] = fresh, own
            # two new words may share a place: keep only what is consistent
            self.scores[place] = own[np.searchsorted(fresh, self.known[place])]
        total = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0, dtype=np.float64)])
        return total[rows[1:]] - total[rows[:-1]]


def _trained(rows: list, pieces: list[bytes], rounds: int) -> Model:
    """rows: (lang, word part, n). Probabilities by EM, from pieces equally likely within a length."""
    lookup = Lookup(pieces)
    languages = sorted({r[0] for r in rows})
    sizes = np.array([len(p) for p in pieces])
    table = np.zeros((len(pieces) + 1, len(languages)))
    for c, lang in enumerate(languages):
        own = [(bytes(w), n) for x, w, n in rows if x == lang]
        data, edges = _spread([w for w, _ in own])
        lengths, weight = np.diff(edges), np.array([n for _, n in own], dtype=float)
        p = np.append(0.25 ** np.minimum(sizes, 4.0) / 64, 0.0)
        p /= p.sum()
        for _ in range(rounds):
            counts = np.zeros(len(pieces) + 1)
            for some, _ in _grouped(lengths, 1 << 17):
                _expected(_matches(lookup, data, edges[:-1][some], lengths[some]), lookup.sizes, lengths[some], p, weight[some], counts)
            counts[-1] = 0
            p = counts + 0.01
            p[-1] = 0
            p /= p.sum()
        table[:, c] = p
    return Model(languages, pieces, table)


def sampled(rows: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """rows (doc_id, text, lang: strings) -> (lang, text): of each language ``sample`` rows at most, those of the least hash.

    Rows that repeat id and text are one.  Those whose 63-bit hash falls below a bound
    set by the language's number of rows are enough in all likelihood, and only they are ranked.
    """
    bound = F.lit(0)
    for lang, n in counts.items():
        share = min(1.0, (sample + 8 * sample**0.5 + 32) / n)
        bound = F.when(F.col("lang") == lang, F.lit(min(int(share * (1 << 63)), (1 << 63) - 1))).otherwise(bound)
    place = F.xxhash64(F.lit("language"), "doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1))
    few = rows.withColumn("_place", place).where(F.col("_place") <= bound).groupBy("lang", "_place").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_place"))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= sample).select("lang", "text")


def train(labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, path: str = VOCABULARY) -> Model:
    """labelled (doc_id, text, lang, ...) -> Model, from rows with text and lang.

    At most ``sample`` rows of each language are learned from, and at most WORDS of
    their word parts; all rows are counted to choose them by hash.  A null id is an id
    like any other here, rows that repeat id and text count once.
    Nothing to learn from gives a model without languages.
    """
    rows = labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = vocabulary(path)
    if not counts:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(pc.utf8_lower(batch.column(1)))
            out: dict[tuple, int] = {}
            for i, lang in enumerate(batch.column(0).to_pylist()):
                starts, ends, _ = word_spans(data, offsets[i : i + 2], SEPARATORS)
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    for part in parts(raw[a:b]):
                        out[lang, part] = out.get((lang, part), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([w for _, w in out], pa.binary()), pa.array(out.values(), pa.int64())], names=["lang", "word", "n"])

    words = sampled(rows, counts, sample).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    often = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    words = words.withColumn("_often", often).where(F.col("_often") <= WORDS)
    return _trained(sorted((r["lang"], bytes(r["word"]), r["n"]) for r in words.collect()), pieces, rounds)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, lang_pred, score), a row for each row.

    ``columns``: names to return before lang_pred and score instead of doc_id.  The
    prediction sees only the text.  A text that is null or has no letter gets ``und``
    and score 0, as does every text if the model has no languages.  The score is the
    prediction's posterior, all languages being equally likely at first; ties go to
    the language that sorts first.
    """
    columns = columns or ["doc_id"]
    # a text that is returned goes to Python once
    at = columns.index("text") if "text" in columns and docs.schema["text"].dataType.typeName() == "string" else None
    picked = docs.select(*columns) if at is not None else docs.select(*columns, F.col("text").cast("string").alias("_text"))
    kept = len(columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:kept])

    def run(batches):
        for batch in batches:
            column = batch.column(kept if at is None else at)
            _, offsets = text_buffer(column)
            logs = []
            for a, b in chunks(offsets, NARROW_BYTES) if model.languages else []:
                logs.append(model.texts(*text_buffer(pc.utf8_lower(column.slice(a, b - a)))))
            texts = [t.is_valid and _has_letter(t.as_py()) for t in column]
            if not logs:
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
            else:
                table = np.concatenate(logs)
                best = table.argmax(axis=1)
                odds = np.exp(table - table.max(axis=1, keepdims=True))
                top = 1 / odds.sum(axis=1)
                names = [model.languages[b] if t else "und" for b, t in zip(best.tolist(), texts, strict=True)]
                scores = [s if t else 0.0 for s, t in zip(top.tolist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:kept], "lang_pred", "score"])

    return picked.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id) -> object:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
