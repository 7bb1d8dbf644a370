"""The corpus operators on small tables: against plain versions, and on nulls, blanks, long texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meshlark.llm import decontam, langid, mixing, pii, sharding, simhash, substring, tokens, urlfilter, winnow

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(40_000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1),
    (2, "another text under the same id", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 4),
    (6, "12345 !!! ...", "en", "b", 13),
    (7, LONG, "en", "c", len(LONG)),
    (None, "a text without an id", "en", "c", 20),
    (8, "Ünïcödé wörds \u00a0 and \U0001f600 more", None, "c", 30),
]
CLASH = ["h", "fp", "g", "shard", "bucket", "window", "_n", "_copy", "_key", "_row", "key", "value", "n_words", "spans", "lang_pred", "size", "slot"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(f"clash{i}"))
    return df.repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# ------------------------------------------------------------------ 1
def check_shards(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_even_and_keep_copies(spark, docs, odd, none):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sharding.assign_shards(docs, 6).collect()
    check_shards(rows, 6)
    groups = defaultdict(set)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        groups[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    rows = sharding.assign_shards(odd, 3).collect()
    check_shards(rows, 3)
    assert len(rows) == len(ODD) and [r["size"] for r in rows if r["doc_id"] == 3] == [8]
    assert sharding.assign_shards(none, 3).count() == 0


def test_shards_split_a_group_larger_than_a_shard(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 250, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.assign_shards(df, 6).collect()
    check_shards(rows, 6)
    held = Counter(r["shard"] for r in rows if r["doc_id"] < 250)
    assert len(held) <= 5  # 100 rows a shard: three at least


# ------------------------------------------------------------------ 2
def test_url_rules_and_propagation(spark):
    pages = [
        (1, "http://A.ORG/x", None),
        (2, "https://sub.example.org/es/1?q", ""),
        (3, "https://example.org/en/10", "<a href='http://bad.net/'>x</a>"),
        (4, "https://good.com/fr/", '<a href="//friend.net/p">'),
        (5, "https://bad.com/de/x", "<A HREF=http://cheat.net>"),
        (6, "http://friend.net/a", None),
        (7, "http://cheat.net/a#f", '<a href="https://bad.com/x">'),
        (8, None, None),
        (9, "no scheme.org/", None),
        (10, "ftp://com", None),
        (11, "x://org?y=://z.com/de/", None),
        (7, "http://cheat.net/a#f", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(df, rules).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, "a.org", "/x", "org/", "allow"),
            (2, "sub.example.org", "/es/1", "example.org/es/", "block"),
            (3, "example.org", "/en/10", "example.org/en/1", "block"),
            (4, "good.com", "/fr/", "com/fr/", "allow"),
            (5, "bad.com", "/de/x", "com/de/", "block"),
            (6, "friend.net", "/a", None, "allow"),
            (7, "cheat.net", "/a", None, "block"),
            (7, "cheat.net", "/a", None, "block"),
            (8, "", "", None, "allow"),
            (9, "", "", None, "allow"),
            (10, "com", "", None, "allow"),
            (11, "org", "", None, "allow"),
        ],
        key=str,
    )
    assert urlfilter.filter_urls(df.limit(0), rules).count() == 0


# ------------------------------------------------------------------ 3
def test_language_is_learned_from_the_other_fold(spark, docs):
    marked = docs.withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(marked.where("not held_out"))
    rows = langid.predict(marked, model, ["doc_id", "held_out", "lang"]).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark, odd, none):
    model = langid.train(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {3, 4, 5, 6}
    assert langid.predict(none, langid.train(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"bb", b"abb"]
    table = np.append(np.array([0.1, 0.2, 0.15, 0.05, 0.2, 0.1, 0.2]), 0)[:, None]
    model = langid.Model(["x"], pieces, table)
    model.prepare()

    def total(word):
        if not word:
            return 1.0
        return sum(table[i, 0] * total(word[len(p) :]) for i, p in enumerate(pieces) if word.startswith(p))

    words = [b"abb", b"a", b"bbab", b"abbabb"]
    assert np.allclose(np.exp(model.words(words)[:, 0]), [total(b" " + w) for w in words])


# ------------------------------------------------------------------ 4
def test_templates_catch_changed_numbers_and_names(spark):
    item = "If Alice buys 12 apples at 3 dollars each and gives Alice half of the 12 apples away how many are left"
    bench = spark.createDataFrame([(1, item), (2, "short one here"), (3, None), (4, "")], "item_id long, text string")
    changed = item.replace("12", "40").replace("Alice", "Robert").replace("3 dollars", "7 euros")
    broken = item.replace("buys 12", "buys 40")  # one value of the item, two of the document
    rows = [(1, "Before it. " + item + " after it."), (2, "x " + changed), (3, broken), (4, "nothing of the kind is in this text at all"), (5, "Short one, here!"), (6, None), (7, ""), (None, item), (1, "twice " + item), (8, " ".join(item.split()[:12]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("window", F.lit(1)).withColumn("item_id", F.lit("x"))
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontam.contaminated(df, bench).collect()}
    assert got[(1, 1)] is False and got[(2, 1)] is True and got[(5, 2)] is False
    assert set(got) == {(1, 1), (2, 1), (5, 2)}
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_templates_catch_names_that_open_sentences_and_lose_their_capitals(spark):
    item = "Tom has 5 apples. Tom gives 2 of them to his sister Mary. Tom buys 7 more apples from Mary at noon. Is Tom richer?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    renamed = item.replace("Tom", "Sam").replace("Mary", "Jane").replace("5", "8")
    torn = item.replace("Tom gives", "Sam gives").replace("Tom buys", "Ken buys").replace("Is Tom", "Is Bob")  # one name of the item, four of the document
    rows = [(1, item), (2, renamed), (3, item.lower()), (5, item.upper()), (6, torn), (7, "Then " + item), (8, "When " + renamed[0].lower() + renamed[1:])]
    got = {r["doc_id"]: (r["reparameterised"], r["coverage"]) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {i: x for i, (x, _) in got.items()} == {1: False, 2: True, 3: False, 5: False, 7: False, 8: True}
    assert all(got[i][1] == 1 for i in (1, 2, 3, 5, 7))


def test_planted_benchmark_passages_are_found(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [(r["item_id"], plain(r["text"])) for r in bench.collect()]
    planted = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in plain(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert planted and planted <= got and len(got - planted) <= 0.05 * len(got)


# ------------------------------------------------------------------ 5
def poisson(u, rate):
    n, p, total = 0, math.exp(-rate), 0.0
    total = p
    while total <= u:
        n += 1
        p *= rate / n
        total += p
    return n


def test_replication_inverts_the_poisson_distribution(spark, docs):
    weights = spark.createDataFrame([("src0", 3.0), ("src1", 1.0), ("src2", -1.0), ("src9", None)], "source string, weight double")
    rates = mixing.source_rates(docs, weights, total=90)
    found = {r["source"]: (r["size"], r["rate"]) for r in rates.collect()}
    assert math.isclose(found["src0"][0] * found["src0"][1], 67.5) and found["src2"][1] == 0
    got = Counter(r["doc_id"] for r in mixing.replicate(docs, rates).collect())
    for r in docs.select("doc_id", "source").collect():
        u = (int(hashlib.md5(f"{mixing.SEED}:copies:{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert got.get(r["doc_id"], 0) == poisson(u, found[r["source"]][1])


def test_replication_of_odd_rows(spark, odd, none):
    rates = mixing.source_rates(odd, power=1.0, total=5.0 * len(ODD))
    out = mixing.replicate(odd, rates)
    assert out.columns[:5] == odd.columns[:5] and out.columns[-2:] == ["_copy", "_key"] and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    keys = [r["_key"] for r in rows]
    assert keys == sorted(keys)
    counts = Counter((r["doc_id"], r["text"]) for r in rows)
    assert counts[(2, ODD[1][1])] == 2 * counts[(2, ODD[3][1])]  # repeated rows are repeated alike
    assert mixing.replicate(none, mixing.source_rates(none)).count() == 0


# ------------------------------------------------------------------ 6
def slow_marks(text, k, w):
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(c):
        return []
    h, _ = winnow._split(winnow._gram_keys(c, min(k, len(c))))
    out = set()
    for i in range(max(1, len(h) - w + 1)):
        part = h[i : i + w].tolist()
        out.add(i + max(j for j, x in enumerate(part) if x == min(part)))
    return [(int(h[p]), p) for p in sorted(out)]


@pytest.mark.parametrize("size", [0, 1, 5, 8, 9, 15, 16, 17, 40, 300])
def test_marks_against_every_window(size):
    rng = np.random.default_rng(size)
    texts = ["".join(rng.choice(list("abä😀"), size)) for _ in range(4)]
    for text, both in zip(texts, winnow.batch_marks([winnow._codes(t) for t in texts], 8, 8), strict=True):
        want = slow_marks(text, 8, 8)
        for h, p in (winnow.marks(winnow._codes(text), 8, 8), both):
            assert list(zip(h.tolist(), p.tolist(), strict=True)) == want


def test_long_texts_go_in_pieces(monkeypatch):
    text = "".join(np.random.default_rng(1).choice(list("abcdef"), 5000))
    monkeypatch.setattr(winnow, "PIECE", 700)
    h, p = winnow.marks(winnow._codes(text), 8, 8)
    assert list(zip(h.tolist(), p.tolist(), strict=True)) == slow_marks(text, 8, 8)


def test_fingerprints_against_the_next_document(spark, docs, odd, none):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)[:120]
    df = spark.createDataFrame([*rows], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in winnow.compare_with_next(df).collect()}
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        a, b, c = (slow_marks(t, winnow.K, winnow.WINDOW) for t in (text, edited, after))
        as_arrays = lambda m: (np.array([h for h, _ in m], np.uint64), np.array([p for _, p in m], np.int64))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (winnow.digest(as_arrays(a)), winnow.digest(as_arrays(b)))
        assert math.isclose(r["near_edited"], winnow.likeness(as_arrays(a)[0], as_arrays(b)[0])) and math.isclose(r["near_next"], winnow.likeness(as_arrays(a)[0], as_arrays(c)[0]))
    rows = winnow.compare_with_next(odd).collect()
    assert len(rows) == len(ODD) and [r["n_chars"] for r in rows if r["doc_id"] == 3] == [0]
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2) and r["n_chars"] > 40}
    assert len(same) == 1
    one = winnow.compare_with_next(odd.where("doc_id = 1")).collect()
    assert one[0]["near_next"] == 1.0 and winnow.compare_with_next(none).count() == 0
    full = by_id(winnow.fingerprints(odd), "hashes", "positions")
    assert full[3] == ([], []) and len(full[7][0]) == len(full[7][1]) > 100


# ------------------------------------------------------------------ 7
def slow_removal(rows, width):
    seen, out = {}, []
    for null, d, h, text in sorted({(d is None, d or 0, h, t or "") for d, h, t in rows}):
        key = (null, d, h)
        words = text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                for j in range(i, i + width):
                    gone[j] = True
            else:
                seen[w] = (key, i)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((key, text, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_windows_go(spark, seed):
    rng = np.random.default_rng(seed)
    phrase = " ".join(rng.choice(list("abcdefgh"), 12))
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(list("abcdef"), int(rng.integers(0, 40))))
        if i % 3 == 0:
            text += "\t" + phrase + "  " + text
        rows.append((i if i % 17 else None, text))
    rows += [rows[5], (5, "other text " + phrase), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = [(r["doc_id"], r["h"], r["text"]) for r in substring._keyed(df).collect()]
    want = Counter((k[1] if not k[0] else None, n, g, s) for k, _, n, g, s in slow_removal([(d, h, t) for d, h, t in keyed if t is not None], 5))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df, width=5, mmer=2).where("n_words > 0").distinct().collect())
    assert got == Counter({k: 1 for k in want if k[1]})


def test_removal_of_odd_rows(spark, odd, none):
    rows = substring.remove_repeats(odd, width=4, mmer=2).collect()
    assert len(rows) == len(ODD)
    first = [r for r in rows if r["doc_id"] == 1][0]
    copies = [r for r in rows if r["doc_id"] == 2 and r["n_words"] > 10]
    assert first["n_removed"] == 0 and [r["n_removed"] for r in copies] == [14, 14]  # a repeated row is one document
    assert [(r["n_words"], r["kept"]) for r in rows if r["doc_id"] in (3, 4, 5)] == [(0, "")] * 3
    assert substring.remove_repeats(none).count() == 0


def test_hot_minimisers_rank_last(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"{' '.join(rng.choice(list('abcdefghijklmnop'), 9))} all rights reserved by us {' '.join(rng.choice(list('abcdefghijklmnop'), 9))}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert 0 < len(substring.hot_minimisers(df, 8, 3)) <= 2 / substring.HOT
    assert substring.remove_repeats(df, width=8, mmer=3).agg(F.sum("n_removed")).first()[0] >= 0


# ------------------------------------------------------------------ 8
def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps, radius):
    nodes = sorted(set(fps))
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_classes(spark, docs, odd, none):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        fps = [slow_fingerprint(r["text"]) for r in rows]
        roots = slow_components(fps, 3)
        least = {}
        for r, fp in zip(rows, fps, strict=True):
            if r["doc_id"] is not None:
                least[roots[fp]] = min(least.get(roots[fp], 1 << 62), r["doc_id"])
        want = Counter((r["doc_id"], f"{fp:016x}", least.get(roots[fp])) for r, fp in zip(rows, fps, strict=True))
        got = simhash.near_classes(df)
        assert Counter((r[0], r[1], r[2]) for r in got.select("doc_id", simhash.hex16(F.col("fp")), "component_id").collect()) == want
    assert simhash.near_classes(none).count() == 0


@pytest.mark.parametrize("cell", [1 << 14, 8])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(cell)
    center = int(rng.integers(1 << 62))
    fps = {center ^ sum(1 << int(b) for b in rng.choice(24, int(rng.integers(0, 6)), replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(1 << 62, size=200)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    from meshlark.llm.graph import components

    got = {r["node"]: r["root"] for r in components(simhash.near_links(df, 3)).collect()}
    want = slow_components(fps, 3)
    assert {x: got.get(x, x) for x in fps} == want


def test_thresholds_sum_to_what_the_pigeonhole_needs():
    cost, thresholds = simhash.allocate([[0, 100, 200], [0, 1, 2], [0, 1, 2]], 3)
    assert sum(thresholds) == 3 - 3 + 1 and thresholds[0] == -1 and cost == 4


# ------------------------------------------------------------------ 9
def test_counts_are_the_tokenizers(spark, docs, odd, none):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokens.vocabulary()
    low = min(s for _, s in pieces)
    vocabulary = [("<unk>", low), *((f"<0x{i:02X}>", low) for i in range(256)), *pieces]
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    assert sentencepiece
    for df in (docs, odd):
        rows = tokens.count_tokens(df).collect()
        texts = Counter((r["doc_id"], len(r["text"] or ""), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
        assert Counter((r["doc_id"], r["n_chars"], r["n_tokens"]) for r in rows) == texts
    assert tokens.count_tokens(none).count() == 0


def test_ties_keep_the_earliest_start():
    c = tokens.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)])
    assert c.word("▁aa") == (-3.0, 2, 0)  # three paths score -3: the piece that starts first wins at each end
    assert c.word("▁ß")[1:] == (3, 2)


# ------------------------------------------------------------------ 10
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[ -]", "", m)) <= 19 and pii._luhn(re.sub("[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def slow_base(text):
    found = [(m.start(), i, m.end(), kind) for i, (kind, pattern, good) in enumerate(BASE) for m in re.finditer(pattern, text) if good(m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


TRICKY = [
    "a@b.c@d.e x@y z.@q.r. +@a.b me@x-y.z.w,you@u.v-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.4 1.2.3 9.9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 4111 1111 1111 1112",
    "+1 (499) 555-6503 +49.30.1234567 +1 2 +123456789012345678 + 12 +1-800-555-0199.",
    "4465758382889437 4465758382889437",
    "é😀 ü@é.com josé@x.com 😀+1 499 555 6503",
    "@" * 50 + "a" * 500 + "@b.c" + "1" * 500 + "." + "+" * 40 + "1" * 40,
]


def test_base_spans_are_the_plain_patterns(spark, docs, odd, none):
    rows = [*((i, t) for i, t in enumerate(TRICKY)), (98, None), (99, ""), (0, TRICKY[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    for table in (df, docs, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect() if r["doc_id"] != 2}
        for r in pii.find(table).collect():
            if r["doc_id"] == 2 and table is not df:
                continue
            want = slow_base(texts[r["doc_id"]]) if r["doc_id"] in texts else slow_base(TRICKY[2])
            assert r["base_spans"] == want
            kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
            assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(kinds.get(k, 0) for k in pii.KINDS)
            assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    assert pii.find(none).count() == 0


def test_the_classifier_adds_spans_and_spares_clean_text(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        rows.append((i, f"please call +1 (499) 555-{i + 6000:04d} or write to user{i}@mail.example.com from host 10.0.{i % 200}.7 thanks"))
    rows += [(1000 + i, f"tel ({rng.integers(200, 900)}) 555-{i + 1000:04d} or mail anna.{i} [at] mail [dot] example [dot] com today") for i in range(40)]
    rows += [(2000 + i, f"we met at noon. The ratio was {i} to 7 in chapter 3 and version 1.2 of it") for i in range(100)]
    rows += [(3000, "numbers 4465758382889437 4465758382889437 together")]
    rows += [(4000 + i, f"paid with card {n} at noon") for i, n in enumerate(x for x in range(4111111111110000, 4111111111112000) if pii._luhn(str(x)))]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not got[2000 + i] for i in range(100))
    assert sum("email" in got[1000 + i] for i in range(40)) >= 36
    assert got[3000].count("card") == 2


def test_candidates_stand_before_those_of_earlier_patterns():
    pairs = [
        ("bob at mail dot org", "alice [at] corp.com", "email"),
        ("2001:db8:0:1:2:3:4:5", "10[.]0[.]3[.]44", "ip"),
        ("4111111111111112", "4111.1111.1111.1112", "card"),
        ("(555) 555-6503", "+1 499-555-6503", "phone"),
    ]
    for first, later, kind in pairs:
        text = f"Write to {first} today. Later: {later} is there."
        got = pii.candidate_spans(text, [])
        assert [text[s:e] for s, k, e in got if pii.KINDS[k] == kind] == [first, later]
    # what overlaps an earlier pattern's match still goes
    assert [e - s for s, _, e in pii.candidate_spans("x [at] y.com @ z.com", [])] == [len("x [at] y.com")]


ALONE = [
    ("ann [at] corp.com", "bob(at)corp (dot) com", "eve {at} corp dot com"),
    ("bob at mail dot org", "bob @ mail dot org"),
    ("bob @ corp.com",),
    ("192[.]168[.]7[.]21", "10(.)0(.)3(.)44", "10[dot]0[dot]3[dot]44", "10 dot 0 dot 3 dot 44", "10[DOT]0[.]3 Dot 44"),
    ("fe80:0:0:1:a:b:c:d", "a:b:c:d:e"),
    ("4111.1111.1111.1112", "4111_1111_1111_11", "4111\u00a01111\u00a01111\u00a01112"),
    ("41111111111111", "4111-1111-1111-1112"),
    ("+1 (499) 555-6503", "+49.30.123.4567"),
    ("(555) 555-6503", "030/123/4567"),
]


@pytest.mark.parametrize("at", range(len(pii.WIDE)))
def test_the_hint_lets_each_wide_pattern_pass(at):
    kind, pattern = pii.WIDE[at]
    for span in ALONE[at]:
        assert pattern.search(span), span
        assert (kind, span) in [(k, span[s:e]) for s, k, e in pii.candidate_spans(span, [])], span


def test_em_learns_which_labelers_to_trust():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    votes = np.zeros((4000, 4), int)
    for j, right in enumerate((0.95, 0.9, 0.85, 0.5)):
        votes[:, j] = np.where((rng.random(4000) < right) == truth, 2, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, table = pii.estimate(patterns, counts.astype(float))
    right = table[:, 1, 2]
    assert right[0] > right[1] > right[2] > right[3] and abs(right[3] - 0.5) < 0.1
    guess = {tuple(p): q > 0.5 for p, q in zip(patterns.tolist(), post, strict=True)}
    assert np.mean([guess[tuple(v)] == t for v, t in zip(votes.tolist(), truth, strict=True)]) > 0.93
