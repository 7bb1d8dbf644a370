"""Retrieval: BM25, dense similarity, rank fusion, reranking and pinned results, for batches of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.lineage import cut
from . import graph

K1, B = 1.5, 0.75
RRF, TOP_K = 60, 2
#: Prefix of every lexical query about a topology, and cards that are always given.
QUERY_PREFIX = "IPv4 behavioral lab topology connected routes later configuration"
ALWAYS = ("CORE-001", "CORE-002", "CORE-003", "MAP-001", "MAP-002", "BACKEND-001", "BACKEND-002", "BACKEND-003", "PLAN-001", "PLAN-002", "ADDR-001", "ADDR-002")
#: Bytes of query vectors that go to all tasks at once.
QUERY_BYTES = 8 << 20
#: Scores that a task holds at once beside its running list, or k for each query if that is more; queries whose list it hands on at once.
SCORE_CELLS, ROWS_OUT = 1 << 20, 4096
#: Model tokens of a query that are embedded together; candidates that are reranked, at least.
WINDOW, CANDIDATES = 160, 16


def postings(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, term, tf), (key, len) and (term, df)."""
    words = docs.select(key, F.explode(tokens(F.col(text))).alias("term"))
    tf = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    sizes = docs.select(key, F.size(tokens(F.coalesce(text, F.lit("")))).cast("long").alias("len"))
    return tf, sizes, tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", query: str = "query_id", text: str = "text", query_text: str = "text", within: tuple[str, ...] = ()) -> DataFrame:
    """docs (key, text), queries (query, text) -> (query, key, score) for documents with a common term.

    Only postings of terms that occur in a query are kept: documents are scanned once,
    tokens filtered against the queries' terms before anything is shuffled, and
    pre-aggregated.  A query's terms count once.  With ``within``, both tables have those
    columns: each of their values is a corpus of its own, with its own statistics.
    """
    own = list(within)
    asked = queries.select(*own, query, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    terms = asked.select(*own, "term").distinct()
    words = tokens(F.coalesce(F.col(text), F.lit("")))
    sized = docs.select(*own, key, words.alias("_w"))
    total = sized.groupBy(*own).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("_w").cast("double")).alias("avg_len"))
    hits = sized.select(*own, key, F.size("_w").alias("len"), F.explode("_w").alias("term")).join(terms, [*own, "term"], "left_semi")
    tf = hits.groupBy(*own, key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*own, "term").agg(F.count(F.lit(1)).alias("df"))
    average = F.when(F.col("avg_len") > 0, F.col("avg_len")).otherwise(1.0)
    rows = asked.join(df, [*own, "term"]).join(tf, [*own, "term"])
    rows = rows.join(total, own) if own else rows.crossJoin(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("len") / average))
    return rows.select(*own, query, key, part.alias("part")).groupBy(*own, query, key).agg(F.sum("part").alias("score"))


def top_k(scores: DataFrame, k: int, query: str = "query_id", key: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best for each query, ties by key, with ``rank`` from 1; cut before the shuffle by Spark's group limit."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def valid_vector(c: Column, dim: int | None = None) -> Column:
    """Finite throughout, not all zero, of the right length."""
    size = F.size(c) == dim if dim is not None else F.size(c) > 0
    return F.coalesce(size & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0), F.lit(False))


def dense_top_k(docs: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, key, score, rank): cosine similarity, exact, the k best for each query.

    Queries are a stated set.  They go to the tasks in blocks of at most QUERY_BYTES; each
    task multiplies them against its batches and keeps one running list of the k best of
    each query, so what it sends does not grow with its documents.
    """
    rows = queries.where(valid_vector(F.col(vector))).select(F.col(query).cast("long").alias(query), F.col(vector).cast("array<double>").alias(vector))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("dim")).first()
    blocks = max(1, -(-(shape["n"] * (shape["dim"] or 0) * 8) // QUERY_BYTES))
    cols = docs.where(valid_vector(F.col(vector))).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    out = None
    for block in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == block)
        got = mine.toPandas()
        part = cols.mapInPandas(_best_of(got[query].to_numpy(), _unit_rows(got[vector]), k, key, query, vector), f"`{query}` long, `{key}` long, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, k, query, key)


def _best_of(names: np.ndarray, table: np.ndarray, k: int, key: str, query: str, vector: str):
    """The k best documents of a task for each of the query vectors; scores rounded to 12 digits, ties by the smaller key."""

    def run(batches):
        ids, scores = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
        for batch in batches:
            if not len(batch) or not len(names):
                continue
            step = max(k, SCORE_CELLS // len(names))
            for at in range(0, len(batch), step):
                some = batch.iloc[at : at + step]
                new = np.round(table @ _unit_rows(some[vector]).T, 12)
                scores = np.concatenate([scores, new], axis=1)
                ids = np.concatenate([ids, np.broadcast_to(some[key].to_numpy(), new.shape)], axis=1)
                if scores.shape[1] > k:
                    least = np.partition(scores, -k, axis=1)[:, -k, None]
                    order = np.lexsort((ids, np.where(scores >= least, -scores, np.inf)), axis=1)[:, :k]
                    scores, ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
        for at in range(0, len(names) if scores.size else 0, ROWS_OUT):
            some = scores[at : at + ROWS_OUT]
            yield pd.DataFrame({query: np.repeat(names[at : at + ROWS_OUT], some.shape[1]), key: ids[at : at + ROWS_OUT].ravel(), "score": some.ravel()})

    return run


def _unit_rows(column) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    m = np.stack([np.asarray(x, dtype=float) for x in column])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fuse(rankings: list[DataFrame], query: str = "query_id", key: str = "doc_id", constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion: rankings (query, key, rank from 1) -> (query, key, score)."""
    every = rankings[0].select(query, key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(query, key, "rank"))
    return every.groupBy(query, key).agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score"))


def rerank(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], k: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """candidates (query, key, query_text, text) -> the k that an injected scorer puts first; windows of one query count by their best."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return scorer(a, b)

    best = candidates.withColumn("score", score("query_text", "text")).groupBy(query, key).agg(F.max("score").alias("score"))
    return top_k(best, k, query, key)


def token_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """A stand-in for a cross-encoder: the number of shared tokens."""
    import re

    words = lambda t: set(re.findall(r"[a-z0-9]+", t.lower()))
    return pd.Series([float(len(words(x) & words(y))) for x, y in zip(a, b, strict=True)])


def pinned_rules(facts: DataFrame) -> DataFrame:
    """facts -> (arch_id, ord, rule_id): cards that a document's graph requires, in order."""
    has = lambda *roles: F.arrays_overlap("roles", F.array(*[F.lit(r) for r in roles]))
    when = lambda c, *ids: [F.when(c, F.lit(i)) for i in ids]
    ids = [
        *[F.lit(i) for i in ALWAYS],
        *when(has("switch", "bridge", "hub"), "L2-001", "L2-003"),
        *when(has("router"), "ROUTE-001"),
        *when(F.col("hosts_cabled"), "EX-PC-DIRECT"),
        *when(F.col("shared_switch"), "EX-LAN"),
        *when(F.col("small_prefix"), "EX-PREFIX31"),
        *when(F.col("standalone"), "EX-STANDALONE"),
        *when(F.col("components") > 1, "EX-ISOLATED"),
    ]
    return facts.select("arch_id", F.posexplode(F.array_distinct(F.array_compact(F.array(*ids)))).alias("ord", "rule_id"))


def feature_queries(facts: DataFrame) -> DataFrame:
    """facts -> (arch_id, queries): what to search for, from the graph alone."""
    known = F.filter("roles", lambda r: r.isin("pc", "server", "router", "switch", "bridge", "hub"))
    asks = F.array(
        F.when(F.size(known) > 0, F.concat(F.lit("device mapping "), F.array_join(known, " "))),
        F.when(F.arrays_overlap("roles", F.array(F.lit("switch"), F.lit("bridge"))), F.lit("switch chain bridge STP loop switching paths")),
        F.when(F.col("small_prefix"), F.lit("point-to-point /31 /32 host route prefix")),
        F.when(F.col("hosts_linked"), F.lit("two directly cabled PCs local traffic peer")),
        F.when(F.col("switch_links"), F.lit("same switch same VLAN local ping ARP")),
    )
    return facts.select("arch_id", F.array_distinct(F.array_compact(asks)).alias("queries"))


def query_windows(queries: DataFrame, encode: Callable[[str], list], decode: Callable[[list], str], text: str = "text", size: int = WINDOW) -> DataFrame:
    """Adds ``windows``: the query in pieces of ``size`` model tokens, by an injected tokenizer."""

    @F.pandas_udf("array<string>")
    def cut_up(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [decode(ids[i : i + size]) for ids in [encode(t)] for i in range(0, len(ids), size)])

    return queries.withColumn("windows", cut_up(text))


def embedded(rows: DataFrame, embed: Callable[[pd.Series], pd.Series], text: str, vector: str = "vector") -> DataFrame:
    """Adds the vector of a text by an injected model; fails on one that is not finite or all zero."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return embed(texts)

    made = rows.withColumn(vector, vectors(text))
    return made.withColumn(vector, F.when(valid_vector(F.col(vector)), F.col(vector)).otherwise(F.raise_error(F.lit("invalid vector")).cast("array<double>")))


def cached_vectors(cards: DataFrame, models: Models, folder: str, model: str = "model") -> DataFrame:
    """(rule_id, vector) of the cards from a table in ``folder`` that is named by the corpus and the model; made anew if it is not there or not whole."""
    spark = cards.sparkSession
    rows = cards.select("rule_id", "text").distinct()
    listed = rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("rule_id", "text")))), 256).alias("print")).first()  # a small corpus
    path = f"{folder}/vectors-{model}-{listed['print']}"
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        stored = spark.read.schema("rule_id string, vector array<double>").parquet(path)
        good = stored.join(rows, "rule_id", "left_semi").where(valid_vector(F.col("vector"))).agg(F.count_distinct("rule_id").alias("n"), F.count_distinct(F.size("vector")).alias("sizes")).first()
        if good["n"] == listed["n"] and good["sizes"] <= 1:
            return stored
    embedded(rows, models.embed, "text").select("rule_id", "vector").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def hybrid_rank(asked: DataFrame, choices: DataFrame, lexical: DataFrame, models: Models, k: int) -> DataFrame:
    """asked (set_id, ask_id, queries: array), choices (set_id, rule_id, place, text), lexical (set_id, ask_id, rule_id, score) -> (set_id, ask_id, rule_id, rank).

    Similarity and reranking take the best over the queries' windows; both rankings are
    fused, and only the first max(3k, CANDIDATES) go to the reranker, whose ties keep the fused order.
    """
    keys = ["set_id", "ask_id"]
    windows = query_windows(asked.select(*keys, F.explode("queries").alias("q")), models.encode, models.decode, "q").select(*keys, F.explode("windows").alias("window")).distinct()
    cards = embedded(choices.select("rule_id", "text").distinct(), models.embed, "text", "card")
    unit = lambda c: F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("card", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    every = asked.select(*keys).join(choices, "set_id")
    near = every.join(embedded(windows, models.embed, "window"), keys).join(cards.select("rule_id", "card"), "rule_id")
    near = near.groupBy(*keys, "rule_id", "place").agg(F.max(F.round(dot / (unit("card") * unit("vector")), 12)).alias("score"))
    order = lambda score, *ties: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties))
    words = every.join(lexical, [*keys, "rule_id"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    ranks = [x.withColumn("rank", order("score", "place")).select(*keys, "rule_id", "place", (F.lit(1.0) / (RRF + F.col("rank"))).alias("part")) for x in (words, near)]
    fused = ranks[0].unionByName(ranks[1]).groupBy(*keys, "rule_id", "place").agg(F.round(F.sum("part"), 12).alias("score"))
    first = fused.withColumn("fused", order("score", "place")).where(F.col("fused") <= max(3 * k, CANDIDATES))
    pairs = first.join(windows, keys).join(choices.select("set_id", "rule_id", "text"), ["set_id", "rule_id"])

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return models.scorer(a, b)

    best = pairs.withColumn("score", score("window", "text")).groupBy(*keys, "rule_id", "fused").agg(F.max("score").alias("score"))
    return best.withColumn("rank", order("score", "fused")).select(*keys, "rule_id", "rank")


@dataclass
class Models:
    """Injected models: a tokenizer's two directions, an embedder of texts, and a scorer of pairs of texts."""

    encode: Callable[[str], list]
    decode: Callable[[list], str]
    embed: Callable[[pd.Series], pd.Series]
    scorer: Callable[[pd.Series, pd.Series], pd.Series]


def retrieve(cards: DataFrame, devices: DataFrame, links: DataFrame, k: int = TOP_K, models: Models | None = None) -> DataFrame:
    """cards (rule_id, text, mode, phase[, place]) and topologies -> (arch_id, place, rule_id, pinned): required cards, then the k best others.

    A document's answer depends on itself and the cards alone.  Documents share few sets
    of required cards and few queries: each set has an index of the other cards, and each
    query is put once.  Ties go by the cards' ``place`` in the corpus (without that
    column, by rule_id).  With ``models`` the ranking is hybrid.  A required card that the
    corpus lacks, or has for another mode or phase, is an error.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    facts = cut(graph.facts(devices, links))
    pinned = pinned_rules(facts)
    place = F.col("place") if "place" in cards.columns else F.row_number().over(Window.orderBy("rule_id"))  # the cards are a fixed, small corpus
    fit = cards.where("mode in ('all', 'behavioral_lab') and phase = 'topology'").withColumn("place", place).select("rule_id", "text", "place")
    lost = sorted(r["rule_id"] for r in pinned.select("rule_id").distinct().join(fit, "rule_id", "left_anti").collect())  # at most as many as there are required cards
    if lost:
        raise ValueError(f"the corpus lacks required cards: {', '.join(lost)}")
    queries = feature_queries(facts).select("arch_id", "queries", F.concat_ws(" ", F.lit(QUERY_PREFIX), F.array_join("queries", " ")).alias("text"))
    sets = pinned.groupBy("arch_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    asks = queries.join(sets, "arch_id").withColumn("set_id", F.sha2(F.array_join("rules", ","), 256)).withColumn("ask_id", F.sha2("text", 256))
    usable = fit.where("not startswith(rule_id, 'EX-')")
    choices = asks.select("set_id", "rules").distinct().join(F.broadcast(usable), ~F.array_contains("rules", F.col("rule_id"))).select("set_id", "rule_id", "text", "place")
    asked = asks.select("set_id", "ask_id", "text", F.concat(F.array("text"), "queries").alias("queries")).dropDuplicates(["set_id", "ask_id"])
    scores = bm25(choices, asked, "rule_id", "ask_id", within=("set_id",))
    if models is None:
        every = asked.select("set_id", "ask_id").join(choices, "set_id").join(scores, ["set_id", "ask_id", "rule_id"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
        order = Window.partitionBy("set_id", "ask_id").orderBy(F.col("score").desc(), "place")
        ranked = every.withColumn("rank", F.row_number().over(order)).select("set_id", "ask_id", "rule_id", "rank")
    else:
        ranked = hybrid_rank(asked, choices, scores, models, k)
    best = asks.select("arch_id", "set_id", "ask_id", F.size("rules").alias("n")).join(ranked.where(F.col("rank") <= k), ["set_id", "ask_id"])
    first = pinned.select("arch_id", (F.col("ord") + 1).alias("place"), "rule_id", F.lit(True).alias("pinned"))
    return first.unionByName(best.select("arch_id", (F.col("rank") + F.col("n")).alias("place"), "rule_id", F.lit(False).alias("pinned")))
