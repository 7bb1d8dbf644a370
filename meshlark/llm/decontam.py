"""Benchmark decontamination by template canonicalisation.

Tokens become canonical: lower-cased words, or typed placeholders for numbers, for units
after a number and for names.  Windows of five canonical tokens are templates; those of the
documents meet those of the benchmark in a hash join.  Along each alignment the
placeholders' values must map consistently (each value of the item has one of the
document; two of the item may become the same, as numbers drawn anew may), which tells a
re-parameterised question from a chance match of its frame.

Frames that many items share are no hot keys: a document that holds enough of an item
holds one of the item's rarest windows, so the join by window takes only those; what it
finds is then compared window by window.

Whether a capitalised word is a name can't be told where it opens a sentence, nor is a
name's copy in lower case known for one.  So a window is emitted in each form that takes
some of its capitalised words as names and the others as words: two windows share a form
if their tokens are the same words or both capitalised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NARROW_BYTES, POWERS, byte_values, chunks, cut, mix, prefix_hash, span_hash, text_buffer, word_spans

WIDTH = 5
#: A window counts only with so many plain words in it.
PLAIN = 2
SHARE = 0.8
#: Bits of the filter of benchmark windows that goes to all tasks (2 MB), whatever the benchmark's size.
FILTER_BITS = 24
VALUES = byte_values(11)
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273))
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal ms s sec secs min mins h hr hrs hz khz mhz ghz w kw mw v a ma pa kpa bar j kj cal kcal k c f b kb mb gb tb "
    "meter meters metre metres kilometer kilometers mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years degree degrees percent "
    "dollar dollars cent cents euro euros watt watts volt volts"
).split()
SPELLED = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()

_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_WORD = _IS_DIGIT.copy()
_IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:;\n\r|\"(")] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = ends - [len(w.encode()) for w in words]
    return np.sort(mix(span_hash(prefix_hash(VALUES[data]), starts, ends)))


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


class _Lists:
    units = _hash_words(UNITS)
    spelled = _hash_words(SPELLED)


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with all names as words, surface hashes, whether each is a number or unit, is capitalised, is a name for sure, and each row's first token.

    A token is a run of ASCII letters, digits and non-ASCII bytes; points and commas
    between digits belong to their number.  Lower case is taken for ASCII and Latin-1
    letters.  A number has a digit, or is spelled out, in as many words as follow each
    other (``ninety-five``); a capitalised word starts
    with a capital that is followed by a small letter, and is a name for sure if it
    opens no sentence.
    """
    own = data[int(offsets[0]) : int(offsets[-1])]
    size = len(own)
    word = _IS_WORD[own]
    if size > 2:
        digit = _IS_DIGIT[own]
        point = (own[1:-1] == 46) | (own[1:-1] == 44)
        word[1:-1] |= point & digit[:-2] & digit[2:]
    lower = own + np.where((own >= 65) & (own <= 90), 32, 0).astype(np.uint8)
    latin = np.zeros(size, bool)  # C3 80 .. C3 9E, but not the multiplication sign
    if size > 1:
        latin[1:] = (own[:-1] == 0xC3) & (own[1:] >= 0x80) & (own[1:] <= 0x9E) & (own[1:] != 0x97)
        lower = lower + np.where(latin, 32, 0).astype(np.uint8)
    # word_spans takes separators by byte value; here they depend on neighbours, so mark them in a copy
    starts, ends, rows = word_spans(word.astype(np.uint8), offsets - offsets[0], np.array([True, *[False] * 255]))
    surface = mix(span_hash(prefix_hash(VALUES[lower]), starts, ends))
    n = len(starts)
    if not n:
        return surface, surface, *[np.zeros(0, bool)] * 3, rows
    numbers = np.concatenate([[0], np.cumsum(_IS_DIGIT[own])])
    spelled = _among(surface, _Lists.spelled)
    number = (numbers[ends] > numbers[starts]) | spelled
    after_number = np.concatenate([[False], number[:-1]])
    opens = np.zeros(n + 1, bool)
    opens[rows] = True
    opens = opens[:n]
    after_number &= ~opens
    unit = after_number & ~number & _among(surface, _Lists.units)
    marks = np.concatenate([[0], np.cumsum(_ENDS[own])])
    opens[1:] |= marks[starts[1:]] > marks[ends[:-1]]
    capital = ((own[starts] >= 65) & (own[starts] <= 90)) | latin[np.minimum(starts + 1, size - 1)]
    second = np.minimum(starts + 1 + (own[starts] == 0xC3), size - 1)
    small = ((own[second] >= 97) & (own[second] <= 122)) | (own[second] >= 128)
    capital = capital & small & (second < ends) & ~number & ~unit
    words = np.where(number, NUMBER, np.where(unit, UNIT, surface))
    follows = spelled & np.concatenate([[False], spelled[:-1]]) & ~opens
    fixed, name = number | unit, capital & ~opens
    if follows.any():
        first = np.flatnonzero(~follows)
        at = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        surface = np.add.reduceat(surface * (2 * at + 1).astype(np.uint64), first)
        words, fixed, capital, name = words[first], fixed[first], capital[first], name[first]
        rows = np.concatenate([[0], np.cumsum(~follows)])[rows]
    return words, surface, fixed, capital, name, rows


def _ahead(marks: np.ndarray) -> np.ndarray:
    """For each token the marks of it and the next WIDTH - 1 ones, as bits."""
    out = marks.astype(np.uint8)
    for i in range(1, WIDTH):
        out[:-i] |= marks[i:].astype(np.uint8) << np.uint8(i)
    return out


def _windows(words: np.ndarray, fixed: np.ndarray, capital: np.ndarray, name: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The forms of the windows that count: first token, row, hash, tokens taken as names (bits), whether these are the sure names,
    hash of that own form, and whether the own form counts."""
    n, sizes = len(words), np.diff(rows)
    prefix = prefix_hash(words)
    first = np.arange(n)
    row = np.repeat(np.arange(len(sizes)), sizes)
    end = np.minimum(first + WIDTH, rows[row + 1]) if n else first
    # a row of fewer tokens than a window has itself as its only one
    fits = (first + WIDTH <= rows[row + 1]) | (first == rows[row]) if n else np.zeros(0, bool)
    counted = np.concatenate([[0], np.cumsum(~fixed)])
    plain = counted[end] - counted[first]
    fits &= plain >= np.minimum(PLAIN, end - first)
    inside = ((1 << (end - first)) - 1).astype(np.uint8)
    able, sure = (_ahead(x) & inside for x in (capital, name))
    first, end, row, plain, able, sure = (x[fits] for x in (first, end, row, plain, able, sure))
    size = (end - first).astype(np.uint64)
    base = span_hash(prefix, first, end)
    POWERS.need(WIDTH)
    gain = [(NAME - words[np.minimum(first + i, n - 1)]) * POWERS.up[i] for i in range(WIDTH)]
    own = base.copy()
    for i in range(WIDTH):
        own += np.where((sure >> np.uint8(i)) & 1 == 1, gain[i], np.uint64(0))
    own = mix(own ^ size)
    counts = plain - np.bitwise_count(sure) >= np.minimum(PLAIN, end - first)
    at, masks, hashes = [], [], []
    some = np.flatnonzero(able)
    for mask in range(1 << WIDTH):
        taken = [i for i in range(WIDTH) if mask >> i & 1]
        # a form has a plain word at least
        on = some[((able[some] & mask) == mask) & (plain[some] > len(taken))] if mask else np.arange(len(first))
        if len(on):
            at.append(on)
            masks.append(np.full(len(on), mask, np.uint8))
            hashes.append(mix(sum((gain[i][on] for i in taken), base[on]) ^ size[on]))
    if not at:
        return first, row, base, able, sure == able, own, counts
    at, masks = np.concatenate(at), np.concatenate(masks)
    return first[at], row[at], np.concatenate(hashes), masks, (masks == sure[at]) & counts[at], own[at], counts[at]


def template_windows(table: DataFrame, key: str, text: str, seen: np.ndarray | None = None) -> DataFrame:
    """(key, window: long, place, values: array<long>, slots: array<boolean>, own: boolean, form: long), a row for each form of each window.

    ``own`` marks the form in which the names are the capitalised words that open no
    sentence; ``form`` is that form's hash, null if it has too few plain words to count.
    With ``seen``, only forms that may be in that filter.
    """

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in chunks(offsets, NARROW_BYTES):
                words, surface, fixed, capital, name, rows = canonical(data, offsets[a : b + 1])
                found = _windows(words, fixed, capital, name, rows)
                if seen is not None:
                    bit = found[2] >> np.uint64(64 - FILTER_BITS)
                    hit = (seen[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    found = tuple(x[hit] for x in found)
                first, row, window, mask, own, form, counts = found
                if not len(first):
                    continue
                at = np.minimum(first[:, None] + np.arange(WIDTH), rows[row + 1][:, None] - 1)
                slots = fixed[at] | ((mask[:, None] >> np.arange(WIDTH, dtype=np.uint8)) & 1 == 1)
                edges = pa.array(np.arange(len(first) + 1) * WIDTH, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(a + row)),
                        pa.array(window.astype(np.int64)),
                        pa.array(first - rows[row], pa.int32()),
                        pa.ListArray.from_arrays(edges, pa.array(surface[at].ravel().astype(np.int64))),
                        pa.ListArray.from_arrays(edges, pa.array(slots.ravel())),
                        pa.array(own),
                        pa.array(form.astype(np.int64), mask=~counts),
                    ],
                    names=[key, "window", "place", "vals", "slots", "own", "form"],
                )

    rows = table.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` long, window long, place int, vals array<long>, slots array<boolean>, own boolean, form long")


def window_filter(windows: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** FILTER_BITS bits of the windows: a bounded object for any benchmark."""

    def run(batches):
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            bit = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) >> np.uint64(64 - FILTER_BITS))
            np.bitwise_or.at(bits, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bits[at].astype(np.int32))], names=["at", "bits"])

    rows = windows.select("window").mapInArrow(run, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()  # 2 ** 21 rows at most
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint8)
    return out


def rare_windows(items: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(item_id, n_windows), and (item_id, window): of each item so many of its rarest windows that no document with ``share`` of the item has none of them."""
    total = items.groupBy("item_id").agg(F.count_distinct("form").alias("n_windows"))
    common = items.groupBy("window").agg(F.count_distinct("item_id").alias("_items"))
    forms = items.join(common, "window").groupBy("item_id", "form").agg(F.max("_items").alias("_items")).join(total, "item_id")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("_items", "form"))
    spare = F.col("n_windows") - F.ceil(F.col("n_windows") * share - 1e-9)
    first = forms.withColumn("_rank", rank).where(F.col("_rank") <= spare + 1).select("item_id", "form")
    return total, items.join(first, ["item_id", "form"]).select("item_id", "window").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> (doc_id, item_id, coverage, n_windows, reparameterised).

    A row for each document that holds ``share`` or more of an item's distinct template
    windows, in alignments whose slot values map consistently; ``reparameterised`` if
    a slot's value differs from the item's.  A capitalised word meets any other one and
    its own copy in lower case, wherever it stands; an alignment counts if its slots map
    consistently either with all forms or with the own forms of both sides alone.  A new
    name in lower case looks like any other word, so its windows are lost.  Items and documents shorter than five
    tokens are one window each, so such an item is found only as a whole document.
    Null ids and null or empty texts match nothing; rows that repeat an id count as one
    document; other columns are ignored.
    """
    items = template_windows(benchmark.where("item_id is not null"), "item_id", "text").where("form is not null")
    items = cut(items.select("item_id", "window", F.col("place").alias("item_place"), F.col("vals").alias("item_vals"), "slots", "form", F.col("own").alias("item_own")))
    seen = window_filter(items)
    hits = cut(template_windows(docs.where("doc_id is not null"), "doc_id", "text", seen).select("doc_id", "window", "place", "vals", "own"))
    total, rare = rare_windows(items, share)
    likely = hits.select("doc_id", "window").distinct().join(rare, "window").select("doc_id", "item_id").distinct()
    pairs = hits.join(likely, "doc_id").join(items, ["item_id", "window"]).withColumn("shift", F.col("place") - F.col("item_place"))
    slot = F.expr(
        "filter(transform(sequence(0, size(slots) - 1), i -> if(slots[i], named_struct('i', item_vals[i], 'd', vals[i]), cast(null as struct<i: bigint, d: bigint>))), x -> x is not null)"
    )
    pairs = pairs.withColumn("strict", F.explode(F.expr("if(own and item_own, array(true, false), array(false))")))
    lines = pairs.groupBy("doc_id", "item_id", "shift", "strict").agg(F.collect_set("form").alias("windows"), F.array_distinct(F.flatten(F.collect_set(slot))).alias("slots"))
    consistent = F.expr("size(array_distinct(transform(slots, x -> x.i))) = size(slots)")
    lines = lines.where(consistent).withColumn("changed", F.expr("exists(slots, x -> x.i <> x.d)"))
    found = lines.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("windows")))).alias("hit"), F.max("changed").alias("reparameterised"))
    out = found.join(total, "item_id").withColumn("coverage", F.col("hit") / F.col("n_windows"))
    return out.where(F.col("coverage") >= share).select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_windows", "reparameterised")
