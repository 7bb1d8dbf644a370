"""Whole words, hot keys, plain matchers and very long texts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from meshlark.llm import decontam, langid, mixing, pii, sharding, substring, tokens, urlfilter, winnow

from .test_operators import DOCS, by_id, docs, none, odd, slow_removal  # noqa: F401
def test_words_are_summed_whole_however_long(monkeypatch):
    rng = np.random.default_rng(5)
    pieces = sorted({bytes([b]) for b in range(97, 101)} | {b" "} | {bytes(rng.integers(97, 101, int(rng.integers(2, 9))).astype(np.uint8)) for _ in range(60)} | {"é".encode(), "éa".encode(), b"\xc3", b"\xa9"})
    table = rng.random((len(pieces), 2))
    table = np.vstack([table / table.sum(0), [0, 0]])
    model = langid.Model(["x", "y"], pieces, table)
    model.prepare()

    def slow(word, c):  # exact up to the last step: fractions of integers do not underflow
        from decimal import Decimal

        word = b" " + word
        sums = [Decimal(1)] + [Decimal(0)] * len(word)
        for j in range(1, len(word) + 1):
            for size in {len(p) for p in pieces}:
                if size <= j and word[j - size : j] in pieces:
                    sums[j] += sums[j - size] * Decimal(float(table[pieces.index(word[j - size : j]), c]))
        return float(sums[-1].ln())

    words = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (0, 1, 23, 24, 39, 40, 41, 64, 100, 700)] + [("é" * 30 + "ab").encode()]
    want = np.array([[slow(w, c) for c in (0, 1)] for w in words])
    assert np.allclose(model.words(words), want, atol=1e-9)
    monkeypatch.setattr(langid, "LONG", 64)  # the longer ones by transfer matrices
    assert np.allclose(model.words(words), want, atol=1e-9)


def test_language_of_scripts_without_spaces(spark):
    rows = [(i, ("私は学生です。今日は天気がいいですね。" if i % 2 else "我是学生。今天天气很好，我们去公园吧。") * 30, "ja" if i % 2 else "zh") for i in range(40)]
    rows += [(100, "今日は学校へ行きます" * 500, None), (101, "我们今天去学校" * 500, None), (102, "² ½ Ⅷ 12", None), (103, "٣٤ !", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(langid.predict(df, langid.train(df)), "lang_pred", "score")
    assert got[100][0] == "ja" and got[101][0] == "zh" and got[102] == ("und", 0.0) and got[103] == ("und", 0.0)
    assert all(got[i][0] == ("ja" if i % 2 else "zh") for i in range(40))


def test_predictions_are_the_sums_over_words(spark):
    rows = [(i, f"{w} word{'abc'[i % 3]} {w}{w}{w} end", "l" + str(i % 3)) for i in range(60) for w in [chr(97 + i % 26) * 30]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    model.prepare()
    for r in langid.predict(df, model, ["doc_id", "text"]).collect():
        logs = model.words([w.encode() for w in re.findall(r"[a-z\x80-\U0010ffff]+", r["text"].lower())]).sum(axis=0)
        odds = np.exp(logs - logs.max())
        assert r["lang_pred"] == model.languages[int(logs.argmax())] and math.isclose(r["score"], 1 / odds.sum(), rel_tol=1e-4)


def test_the_sample_is_bounded_and_counts_repeats_once(spark):
    rows = [(i, f"text {i}", "a") for i in range(300)] + [(None, "same text", "a")] * 300 + [(i, f"other {i}", "b") for i in range(20)]
    df = spark.createDataFrame([(str(i) if i is not None else None, t, x) for i, t, x in rows], "doc_id string, text string, lang string")
    got = Counter(r["lang"] for r in langid.sampled(df, {"a": 600, "b": 20}, 30).collect())
    assert got["a"] == 30 and got["b"] == 20
    texts = Counter(r["text"] for r in langid.sampled(df, {"a": 600, "b": 20}, 1000).collect())
    assert len(texts) == 321 and set(texts.values()) == {1}
    assert all(max(map(len, langid.parts(w))) <= langid.PART and b"".join(langid.parts(w)) == b" " + w for w in (b"", b"x" * 200, "é".encode() * 100, "今".encode() * 99, "😀".encode() * 33))


# a plain matcher for op 4
def plain_tokens(text):
    """(surface, type: n number, u unit, w word; capitalised) of a text, spelled-out numbers that follow each other as one."""
    out, opens, after_number = [], True, False
    spelled, units = set(decontam.SPELLED), set(decontam.UNITS)
    end = 0
    for m in re.finditer(r"(?:[A-Za-z0-9\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+", text):
        opens = not out or bool(re.search('[.!?:;\n\r|"(]', text[end : m.start()]))
        end = m.end()
        low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in m.group())
        if low in spelled or re.search("[0-9]", low):
            kind = "n"
        else:
            kind = "u" if after_number and low in units else "w"
        cap = kind == "w" and bool(re.match("(?:[A-Z]|[À-ÖØ-Þ])[a-z\x80-\U0010ffff]", m.group()))
        after_number = kind == "n"
        if low in spelled and not opens and out and out[-1][3]:
            out[-1] = (out[-1][0] + " " + low, "n", False, True)
        else:
            out.append((low, kind, cap, low in spelled))
    return out


def plain_matches(docs, items, share):
    """By all windows of all items against all windows of all documents."""
    import itertools

    def windows(text):
        t = plain_tokens(text)
        for i in range(max(1, len(t) - 4)):
            w = t[i : i + 5]
            if w and sum(k == "w" for _, k, _, _ in w) >= min(2, len(w)):
                yield i, w

    def own(w, starts):
        return tuple("N" if s else {"n": 0, "u": 1}.get(k, x) for (x, k, _, _), s in zip(w, starts, strict=True))

    found = set()
    for item, text in items:
        # a window's own form takes capitalised words as names where they open no sentence
        want = {}
        sure = sure_names(text)
        for i, w in windows(text):
            s = sure[i : i + 5]
            if sum(k == "w" and not n for (_, k, _, _), n in zip(w, s, strict=True)) >= min(2, len(w)):
                want[i] = (w, own(w, s))
        total = len({f for _, f in want.values()})
        for doc, body in docs:
            lines = {}
            for (j, d), (i, (w, form)) in itertools.product(list(windows(body)), want.items()):
                if len(d) != len(w) or not all(k == l and (k in "nu" or x == y or (c and e)) for (x, k, c, _), (y, l, e, _) in zip(d, w, strict=True)):
                    continue
                if not sum(k == "w" and not (c and e and x != y) for (x, k, c, _), (y, _, e, _) in zip(d, w, strict=True)):
                    continue
                lines.setdefault(j - i, []).append((form, [(y, x) for (x, k, c, _), (y, _, e, _) in zip(d, w, strict=True) if k in "nu" or (c and e)]))
            hit = set()
            for pairs in lines.values():
                slots = {p for _, q in pairs for p in q}
                if len({a for a, _ in slots}) == len(slots):
                    hit |= {f for f, _ in pairs}
            if total and len(hit) / total >= share:
                found.add((doc, item))
    return found


def sure_names(text):
    out, end = [], 0
    tokens = plain_tokens(text)
    spans = list(re.finditer(r"(?:[A-Za-z0-9\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+", text))
    opens = [i == 0 or bool(re.search('[.!?:;\n\r|"(]', text[spans[i - 1].end() : m.start()])) for i, m in enumerate(spans)]
    at = 0
    for token in tokens:
        out.append(token[2] and not opens[at])
        at += token[0].count(" ") + 1
    return out


def test_contamination_against_a_plain_matcher(spark, docs, odd, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    changed = [(10_000 + i, re.sub(r"[0-9]+", lambda m: str(int(m.group()) + 3), "Before. " + t + " After it all.")) for i, t in items]
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").limit(30).collect()] + changed
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()}
    assert got == plain_matches(rows, items, decontam.SHARE) and len(got) >= len(items)
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(odd, odd.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("form"))).count() > 0


def test_spelled_numbers_of_several_words_are_one_slot(spark):
    item = "The farmer sold ninety-five eggs on monday and forty two eggs on the next day of the week so what is the sum of both"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("ninety-five", "sixty").replace("forty two", "13")), (2, item.replace("ninety-five", "sixty").replace("forty two", "three hundred thousand")), (3, "The farmer sold eggs on monday")]
    got = {r["doc_id"]: (r["reparameterised"], r["coverage"]) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: (True, 1.0), 2: (True, 1.0)}


def test_frames_that_all_items_share_make_no_candidates(spark):
    own = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{j}" for j in "abcdef")
    frame = "answer the following question in one short sentence and explain why you think so"
    bench = spark.createDataFrame([(i, f"{frame} {own(i)} thank you") for i in range(40)], "item_id long, text string")
    df = spark.createDataFrame([(i, frame) for i in range(200)] + [(1000, f"{frame} {own(7)} thank you")], "doc_id long, text string")
    items = decontam.template_windows(bench, "item_id", "text").where("form is not null").withColumnRenamed("place", "item_place")
    _, rare = decontam.rare_windows(items, decontam.SHARE)
    assert rare.groupBy("window").count().agg(F.max("count")).first()[0] == 1
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()} == {(1000, 7)}


def test_urls_of_odd_rows_and_hot_hosts(spark):
    hot = [(i, f"http://hot.net/{'de' if i % 2 else 'x'}/{i}", f"<a href='http://h{i % 9}.com/'>") for i in range(900)]
    rest = [(1000 + i, f"http://h{i % 9}.com/{'de' if i % 3 else 'fr'}/{i}", "x" * 200_000 if i == 5 else None) for i in range(60)]
    rows = [*hot, *rest, (None, None, None), (7, "http://HOT.net/de/7", None), (7, "http://HOT.net/de/7", None), (8, "", ""), (9, "http:///x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "path", "rule", "verdict", "_salt", "_parts", "_heads", "trust", "n"):
        df = df.withColumn(c, F.lit("clash"))
    rules = spark.createDataFrame(urlfilter.RULES + [("hot.net", "/de/", "block")], "host string, path string, verdict string")
    got = urlfilter.filter_urls(df, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["host"] == "hot.net":
            assert (r["rule"], r["verdict"]) == (("hot.net/de/", "block") if r["path"].startswith("/de/") else (None, r["verdict"]))
    assert len({r["verdict"] for r in got if r["host"] == "hot.net" and r["rule"] is None}) == 1  # one threshold for each host
    assert urlfilter.hot_hosts(df.withColumn("host", F.lit("a"))).count() <= 1


def test_marks_are_returned_with_their_places(spark, docs):
    rows = winnow.compare_with_next(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows[::9]:
        h, p = winnow.marks(winnow._codes(texts[r["doc_id"]]))
        assert (r["mark_hashes"], r["mark_positions"]) == (h.astype(np.int64).tolist(), p.tolist()) and r["fingerprint"] == winnow.digest((h, p))


def test_order_holds_for_equal_ids_and_more_parts_than_rows(spark):
    rows = [(i % 3 if i % 5 else None, f"text number {i % 7} " * (1 + i % 4)) for i in range(40)] + [(1, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = {r[1]: r[0] for r in df.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("t")).collect()}
    line = sorted(((d is None, -(d or 0), key_of, t) for d, t in ((d, t or "") for d, t in rows) for key_of in [{v: k for v, k in key.items()}[t]]))
    want = Counter()
    for (null, d, _, t), (_, _, _, after) in zip(line, [*line[1:], line[0]], strict=True):
        want[None if null else -d, hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest()] += 1
    for parts in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = Counter((r["doc_id"], r["edited_sha256"]) for r in winnow.compare_with_next(df).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == want


def test_passages_of_hot_runs_are_removed_whole(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} {line} c{i} {line if i % 4 == 0 else ''}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(substring.hot_minimisers(df, 8, 3, 1 / 100)) > 0
    monkeypatch.setattr(substring, "HOT", 1 / 100)
    keyed = [(r["doc_id"], r["h"], r["text"]) for r in substring._keyed(df).collect()]
    want = {k[1]: (n, g, s) for k, _, n, g, s in slow_removal(keyed, 8)}
    assert by_id(substring.remove_repeats(df, width=8, mmer=3), "n_words", "n_removed", "kept_sha256") == want


def test_added_spans_against_a_plain_pass(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    rows += [(10_000 + i, f"mail anna.{i} [at] mail [dot] example [dot] com or (555) 555-{1000 + i} or 10[.]0[.]3[.]{i}") for i in range(60)]
    spans = {}
    for i, t in rows:
        base = pii.base_spans(t)
        spans[i] = [(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in pii.candidate_spans(t, base)]
    texts = dict(rows)
    codes = {(i, s, k, e): pii._votes(texts[i], k, s, e, b) for i, own in spans.items() for s, k, e, b in own}
    models = {}
    for kind in range(4):
        seen = Counter(c for (_, _, k, _), c in codes.items() if k == kind)
        if seen:
            patterns, counts = np.array(sorted(seen)), np.array([seen[c] for c in sorted(seen)], float)
            votes, features = pii.decode(patterns)
            models[kind] = pii.train(pii._design(votes, features), pii.estimate(votes, counts)[0], counts)
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")), "spans", "n_spans")
    for i, own in spans.items():
        kept = [(s, k, e) for s, k, e, b in own if b]
        rated = []
        for s, k, e, b in own:
            if not b:
                z = float(pii._design(*pii.decode(np.array([codes[i, s, k, e]])))[0] @ models[k])
                rated.append((-z, s, k, e))
        for z, s, k, e in sorted(rated):
            if 1 / (1 + math.exp(z)) >= 0.8 and not any(s < b and a < e for a, _, b in kept):
                kept.append((s, k, e))
        assert got[i] == (",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(kept)), len(kept))


def test_recall_on_planted_spans_of_every_kind(spark):
    rng = np.random.default_rng(8)
    card = lambda: next(str(n) for n in range(int(rng.integers(4 * 10**15, 5 * 10**15)), 10**16) if pii._luhn(str(n)))
    make = {
        "email": lambda i: [f"user{i}@mail.example.com", f"bob{i} at mail dot example dot org", f"eve{i} [at] corp.com"],
        "ip": lambda i: [f"10.{i % 200}.3.44", f"192[.]168[.]{i % 200}[.]21", f"2001:db8:0:{i % 90 + 10}:2:3:4:5"],
        "card": lambda i: [card(), "-".join(re.findall("....", card())), ".".join(re.findall("....", card()))],
        "phone": lambda i: [f"+1 (499) 555-{6000 + i}", f"+49 30 {1234567 + i}", f"(555) 555-{1000 + i}"],
    }
    lead = {"email": "write to", "ip": "the server is", "card": "paid by card", "phone": "please call"}
    rows, planted = [], []
    for kind, forms in make.items():
        for i in range(120):
            for form, value in enumerate(forms(i)):
                rows.append((len(rows), f"some words before, {lead[kind]} {value} and thanks to all of you"))
                planted.append((kind, form, value))
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")), "spans")
    hit = Counter()
    for (i, text), (kind, form, value) in zip(rows, planted, strict=True):
        at = text.index(value)
        hit[kind, form] += f"{kind}:{at}:{at + len(value)}" in got[i][0].split(",")
    assert {k: n / 120 for k, n in hit.items() if n < 0.9 * 120} == {}


def test_propagation_brings_links_together(spark):
    df = spark.range(3000).select((F.col("id") % 500).alias("g"), F.pmod(F.xxhash64("id"), F.lit(8)).cast("int").alias("shard"), F.col("id").alias("doc_id"))
    before, out = sharding.cut_links(df), sharding.propagate(df, 8, 3000 // 8)
    assert before > 6000 and sharding.cut_links(out) <= 0.05 * before
    settled = out.groupBy("g").agg(F.count_distinct("shard").alias("s"), F.min("shard").alias("shard"), F.count(F.lit(1)).alias("n")).where("s = 1")
    assert settled.groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= 3000 // 8


def test_rates_beyond_the_small_table_are_joined(spark, docs, monkeypatch):
    rates = mixing.source_rates(docs)
    want = Counter((r["doc_id"], r["_copy"]) for r in mixing.replicate(docs, rates).collect())
    monkeypatch.setattr(mixing, "SMALL_TABLE", 0)
    out = mixing.replicate(docs, rates)
    assert Counter((r["doc_id"], r["_copy"]) for r in out.collect()) == want
    places = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(places) == 4 and max(r["count"] for r in places) < 2 * sum(want.values()) / 4


def test_very_long_texts(spark):
    words = " ".join(f"word{i % 4001} of{i % 37}" for i in range(900_000))  # 10 MB
    run = "x" * 3_000_000
    rows = [(1, words, "en", "a", 1), (2, run, "en", "a", 1), (3, "a short text in the same table here", "en", "b", 1)]
    df = spark.createDataFrame(rows, DOCS)
    assert len(langid.predict(df, langid.train(df)).collect()) == 3
    assert by_id(tokens.count_tokens(df), "n_chars")[2] == (3_000_000,)
    assert by_id(substring.remove_repeats(df), "n_words")[1] == (1_800_000,)
    assert decontam.contaminated(df, df.select(F.col("doc_id").alias("item_id"), "text").where("item_id = 3")).select("doc_id").collect()[0][0] == 3
    assert by_id(pii.find(df), "spans") == {1: ("",), 2: ("",), 3: ("",)}
