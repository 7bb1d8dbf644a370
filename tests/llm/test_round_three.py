"""MinHash classes, ranked search and hard negatives against plain versions, and on odd rows."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshlark.llm import minhash, negatives, pii, ranked, sharding

DOCS = "doc_id long, text string"
CLASH = ["n", "s1", "bands", "node", "key", "root", "hub", "most", "own", "first", "terms", "tfs", "item", "rank", "score", "row", "g", "positives"]


def clashing(df):
    for i, c in enumerate(x for x in CLASH if x not in df.columns):
        df = df.withColumn(c, F.lit(f"clash{i}"))
    return df


# ------------------------------------------------------------------ 11
def shingles(text, k=3):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_classes(rows, share, k=3):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least[top(i)], d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[top(i)]
        c = None if c == math.inf else c
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def got_classes(df, share=85):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_classes(df, share).collect()), key=str)


def near_texts(seed, n=60, size=60):
    """Texts around a few bases: chains in which only neighbours are near, crowds around one text, and strangers."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(5000)}"
    rows, i = [], 0
    base = [word() for _ in range(size)]
    for _ in range(n):  # a chain: each changes a word of the one before
        base = list(base)
        base[int(rng.integers(size))] = word()
        rows.append((i, " ".join(base)))
        i += 1
    base = [word() for _ in range(size)]
    for _ in range(n):  # a crowd: each changes up to five words of one text
        own = list(base)
        for at in rng.choice(size, int(rng.integers(6)), replace=False):
            own[at] = word()
        rows.append((i, "  ".join(own).upper()))
        i += 1
    for _ in range(n):
        rows.append((i, " ".join(word() for _ in range(int(rng.integers(1, size))))))
        i += 1
    order = rng.permutation(len(rows))
    return [(int(order[k]), t) for k, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_classes_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "CELL_ROWS", 5)  # cells of parts of buckets
    rows = near_texts(seed)
    assert got_classes(spark.createDataFrame(rows, DOCS)) == plain_classes(rows, 85)


def test_minhash_on_the_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got_classes(spark.createDataFrame(rows, DOCS)) == plain_classes(rows, 85)


def test_minhash_odd_rows(spark, monkeypatch):
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(40_000))
    rows = [
        (9, "one two three four"), (3, "ONE two\tthree  four"), (3, "one two three four"), (3, "something else under the same id"),
        (5, "a b"), (6, "A  b"), (7, "a b c"), (8, "a"), (1, None), (2, None), (4, ""), (10, " \t\n "), (11, ""),
        (None, "no id at all here"), (None, "no id at all here"), (None, "one two three four"),
        (12, long), (13, long + " end"), (14, "Ünïcödé wörds and more of them"), (15, "ünïcödé wörds and more of them"),
    ]
    want = []
    for d, n, c, kept in plain_classes(rows, 85):
        want.append((d, n, c, kept or (d is None and c is None)))
    df = clashing(spark.createDataFrame(rows, DOCS)).repartition(3)
    assert got_classes(df) == sorted(want, key=str)
    monkeypatch.setattr(minhash, "PIECE", 1000)
    monkeypatch.setattr("meshlark.llm.common.CHUNK_BYTES", 500)
    assert list(minhash.shingle_sets(pa.array([long]), 3))[0][2][0] == len(shingles(long))
    assert minhash.near_classes(df.limit(0)).count() == 0
    assert minhash.near_classes(spark.createDataFrame([(1, None)], DOCS)).collect()[0]["kept"]


def test_minhash_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    for size in (7, 50, 2000):  # far fewer than bins, and more
        errors = []
        for _ in range(40):
            pool = rng.permutation(values)
            a, b = np.sort(pool[:size]), np.sort(pool[size // 7 : size // 7 + size])
            both = len(np.intersect1d(a, b))
            s = minhash.signatures(np.concatenate([a, b]), np.array([size, size]))
            errors.append((s[0] == s[1]).mean() - both / (2 * size - both))
        assert abs(np.mean(errors)) < 0.03


def test_shared_counts_equal_intersections(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(9)
    for m in (1, 2, 3, 40):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50), dtype=np.uint64)) for _ in range(m)]
        got = minhash.shared_counts(np.array([len(x) for x in sets]), np.concatenate(sets))
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(m) for j in range(i))


# ------------------------------------------------------------------ 12
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in counted:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def got_search(docs, items, k):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked.search(docs, items, k).collect()), key=str)


ITEMS = "item_id long, text string"


def test_search_equals_a_plain_ranking(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in range(60)] + ["É", "naïve", "x-y", "A_b"]
    text = lambda n: " ".join(words[int(i)] for i in np.minimum(rng.exponential(12, n), 63))
    docs = [(int(i), text(int(rng.integers(0, 40)))) for i in rng.permutation(400)]
    items = [(i, text(int(rng.integers(1, 12))).upper()) for i in range(30)]
    d, i = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)
    want = plain_search(docs, items, 7)
    monkeypatch.setattr(ranked, "BLOCK", 32)
    assert got_search(d, i, 7) == want
    monkeypatch.setattr(ranked, "ITEM_BYTES", 300)  # several sweeps
    assert got_search(d, i, 7) == want


def test_search_odd_rows(spark, monkeypatch):
    long = " ".join(f"word{i % 977}-of{i % 31}" for i in range(40_000))
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (2, "ALPHA beta"), (3, None), (4, ""), (5, "... !"), (6, long), (7, "ünï É éa"), (0, "gamma"), (8, "alpha " * 50)]
    items = [(1, "alpha"), (1, "alpha"), (1, "word5 of3"), (2, None), (3, ""), (4, "nothing of this kind"), (None, "É beta beta"), (5, "???")]
    d, i = clashing(spark.createDataFrame(docs, DOCS)), clashing(spark.createDataFrame(items, ITEMS))
    monkeypatch.setattr(ranked, "PIECE", 100)
    assert got_search(d, i, 3) == plain_search(docs, [x for x in items if x[1] is not None], 3)
    assert ranked.search(d.limit(0), i).count() == 0 and ranked.search(d, i.limit(0)).count() == 0


def test_impacts_beyond_the_product_of_64_bits():
    n = np.array([10**9, 5], dtype=np.int64)
    got = ranked.impacts(np.array([3, 1], dtype=np.int64), n, 10**10, 10**13)
    assert got.tolist() == [10**9 * t // (1000 * t + 12 * (75 + 25 * x * 10**10 // 10**13)) for t, x in ((3, 10**9), (1, 5))]


# ------------------------------------------------------------------ 13
VECTORS = "id long, label int, vector array<float>"


def plain_negatives(rows, every, np_=5, nn=3):
    rows = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (ai, al, av) in enumerate(rows):
        if ai % every:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, r, l) for r, (i, l, v) in enumerate(rows) if r != a]
        scored.sort()
        for s, i, _, _ in [x for x in scored if x[3] == al][:np_]:
            p = -s
            fit = [x for x in scored if x[3] != al and 50 * p <= -100 * x[0] <= 95 * p][:nn]
            out += [(ai, i, k + 1, x[1], p, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def got_negatives(df, every):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in names) for r in negatives.hard_negatives(df, F.col("id") % every == 0).collect())


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_negatives_equal_a_full_sort(spark, monkeypatch, scale):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 20)
    monkeypatch.setattr(negatives, "SCORES", 500)
    rng = np.random.default_rng(6)
    rows = [(int(i), int(rng.integers(4)), [float(np.float32(x)) * scale for x in np.round(rng.normal(size=5), 1)]) for i in rng.permutation(150)]
    rows += [(200, 9, [1.0 * scale] * 5), (205, 2, [0.0] * 5), (210, 1, [-1.0] * 5)]  # a label of its own, no length, no positive score
    want = plain_negatives(rows, 5)
    assert want and got_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), 5) == want


def test_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 1, [0.9, 1.0]), (3, 2, [0.9, 0.9]), (4, 2, [0.7, 0.5]), (5, 2, [0.7, 0.5]), (5, 2, [0.7, 0.5]), (6, None, [1.0, 1.0]), (7, 2, None),
        (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (11, 2, [None, 1.0]), (None, 2, [0.8, 0.8]), (12, 2, []), (13, 2, [1.5]), (14, 2, [0.5, 0.5, 9.0]),
    ]
    df = clashing(spark.createDataFrame(rows, VECTORS))
    want = plain_negatives(rows, 10)
    assert want and got_negatives(df, 10) == want
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 5 == 0).count() == 0


# ------------------------------------------------------------------ quotas and spans
def test_wishes_stay_within_quota(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANK_ROWS", 10)  # many buckets
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 9), rng.randrange(4)) for i in range(600)]
    free = [200, 0, 5000, 37]
    got = sharding.within_quota(spark.createDataFrame(rows, "g long, m long, to int"), free, 1).collect()
    sums = Counter()
    for r in got:
        sums[r["to"]] += r["m"]
    asked = Counter()
    for _, m, to in rows:
        asked[to] += m
    assert all(sums[t] <= free[t] for t in range(4)) and sums[2] == asked[2]
    assert sums[0] > 200 - 9 and sums[3] > 37 - 9  # a prefix of the wishes, cut where the next does not fit


def test_accepted_spans_equal_all_pairs():
    rng = random.Random(1)
    for _ in range(50):
        spans = [(s := rng.randrange(200), rng.randrange(4), s + rng.randrange(1, 15)) for _ in range(40)]
        base, ranked_ = spans[:10], spans[10:]
        want = list(base)
        for s, k, e in ranked_:
            if all(e <= a or s >= b for a, _, b in want):
                want.append((s, k, e))
        assert pii.accepted(base, ranked_) == want


def test_candidates_equal_all_pairs():
    rng = random.Random(4)
    parts = ["bob at mail dot org", "alice [at] corp.com", "10[.]0[.]3[.]44", "2001:db8:0:1:2:3:4:5", "4111/1111/1111/1111", "4111111111111111", "+1 212 555 0100", "(212) 555-0100", "x@y.com", "see", "a @ b.co.uk.de.fr.it.es", "12 345 6789"]
    for _ in range(60):
        text = rng.choice([" ", ", ", " ", "-"]).join(rng.choice(parts) for _ in range(25))
        base = pii.base_spans(text)
        want: list = []
        for kind, pattern in pii.WIDE:
            for m in pattern.finditer(text):
                s, e = m.span()
                if all(e <= a or s >= b for a, _, b in base) and all(e <= a or s >= b for a, k, b in want if k == kind):
                    want.append((s, kind, e))
        assert pii.candidate_spans(text, base) == sorted(want)
    assert pii.candidate_spans("write to a at b dot c dot d dot e dot f dot com now", [])[0][2] == 47


def test_a_text_with_a_hundred_thousand_spans():
    text = " ".join(f"x{i} at corp{i} dot com, +1 212 555 {i % 10000:04d};" for i in range(50_000))
    start = time.perf_counter()
    base = pii.base_spans(text)
    found = pii.candidate_spans(text, base)
    assert len(base) == len(found) == 50_000 and len(pii.accepted(base, found)) == 100_000
    assert time.perf_counter() - start < 20
