"""The registered queries of this subpackage; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, minhash, mixing, negatives, pii, ranked, sharding, simhash, substring, tokens, urlfilter, winnow


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on 24 shards, copies together, counts at most one apart."""
    return sharding.assign_shards(_documents(spark, sf_dir), shards=24)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on page urls by rules, else by trust and distrust of their hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, learned from those that are not held out."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, its numbers, names and units changed or not."""
    return decontam.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated so that sources weigh the square root of their size."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars")
    mixed = mixing.replicate(docs, mixing.source_rates(docs))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", F.col("_copy").alias("copy"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents, against their edited texts and their successors."""
    return winnow.compare_with_next(_documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that remain when later copies of 20-word windows go."""
    out = substring.remove_repeats(_documents(spark, sf_dir), width=20, keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: 3-word shingles, at most 3 differing bits."""
    classes = simhash.near_classes(_documents(spark, sf_dir), shingle=3, radius=3)
    return classes.select("doc_id", simhash.hex16(classes["fp"]).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of documents."""
    return tokens.count_tokens(_documents(spark, sf_dir))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents: the base patterns, and what the span classifier adds."""
    out = pii.find(_documents(spark, sf_dir))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans")


def op11_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: 3-word shingle sets at a Jaccard similarity of 0.85 or more."""
    return minhash.near_classes(_documents(spark, sf_dir), share=85, k=3)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return ranked.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, every seventh label being off by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.hard_negatives(vectors, F.col("id") % 50 == 0)


def queries() -> dict:
    return {
        "op1_balanced_shards": op1_balanced_shards,
        "op2_url_filter": op2_url_filter,
        "op3_language_id": op3_language_id,
        "op4_benchmark_leaks": op4_benchmark_leaks,
        "op5_source_mix": op5_source_mix,
        "op6_winnowing": op6_winnowing,
        "op7_substring_dedup": op7_substring_dedup,
        "op9_token_counts": op9_token_counts,
        "op10_pii_spans": op10_pii_spans,
        "op8_simhash_components": op8_simhash_components,
        "op11_minhash_components": op11_minhash_components,
        "op12_ranked_search": op12_ranked_search,
        "op13_hard_negatives": op13_hard_negatives,
    }


OP5_SQL = f"""
WITH s AS (SELECT source, count(*)::DOUBLE AS size FROM documents GROUP BY source),
r AS (SELECT source, sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () / size AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 24))::BIGINT + 1)) AS k FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT *, (('0x' || substr(md5('{mixing.SEED}:copies:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) AS n FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INTEGER AS copy FROM n
"""

OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
i AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM i),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM k WHERE nth > 1),
t AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
s AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS kept, count(*) AS n FROM t ANTI JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON s.doc_id = w.doc_id
"""

OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
k AS MATERIALIZED (SELECT s, len(s) AS n, min(doc_id) AS id FROM (SELECT doc_id, list_sort(s) AS s FROM g) GROUP BY s),
x AS (SELECT id, n, unnest(s) AS h FROM k),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.h = b.h AND a.id < b.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY a.id, b.id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT id AS a, id AS b FROM k WHERE n > 0 UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS id, min(b) AS root FROM r GROUP BY a)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, coalesce(c.root, g.doc_id) AS component_id, coalesce(c.root, g.doc_id) = g.doc_id AS kept
FROM g JOIN k ON k.s = list_sort(g.s) LEFT JOIN c ON c.id = k.id
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::BIGINT AS size FROM f GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(size)::BIGINT AS total FROM l),
m AS (SELECT doc_id, 75 + (25 * size * docs) // total AS m FROM l, s),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

OP13_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _op2_sql() -> str:
    d, upper, lower = urlfilter.DAMPING, urlfilter.UPPER, urlfilter.LOWER
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)
    links = urlfilter.LINK.replace("'", "''")
    steps = []
    for turn in range(urlfilter.ROUNDS):
        was = f"s{turn}"
        steps.append(
            f"""s{turn + 1} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
SELECT host, trust, distrust FROM s0 UNION ALL
SELECT e.dst, {d} * x.trust * e.forward, 0 FROM {was} x JOIN e ON e.src = x.host UNION ALL
SELECT e.src, 0, {d} * x.distrust * e.back FROM {was} x JOIN e ON e.dst = x.host) GROUP BY host)"""
        )
    return f"""
WITH p AS MATERIALIZED (SELECT page_id, html, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{upper}', '{lower}') ELSE '' END AS host,
 CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES {rules}),
m AS (SELECT page_id, max_by({{'rule': rhost || rpath, 'verdict': rverdict}}, length(rhost || rpath)) AS won FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
r AS MATERIALIZED (SELECT p.page_id, p.host, p.path, m.won.rule AS rule, m.won.verdict AS verdict FROM p LEFT JOIN m USING (page_id)),
f AS (SELECT host AS src, unnest(regexp_extract_all(html, '{links}', 1)) AS link FROM p WHERE host <> ''),
f2 AS (SELECT src, translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END, '://([^/?#]*)', 1), '{upper}', '{lower}') AS dst FROM f),
up AS (SELECT DISTINCT p.host AS src, q.host AS dst FROM p JOIN (SELECT DISTINCT host FROM p WHERE host <> '') q ON q.host = regexp_extract(p.host, '^[^.]*[.](.+[.].+)$', 1)),
l AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, count(*) AS n FROM f2 WHERE dst <> '' AND src <> dst GROUP BY ALL UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY ALL),
e AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forward, n / sum(n) OVER (PARTITION BY dst) AS back FROM l),
h AS (SELECT host, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM r WHERE rule IS NOT NULL GROUP BY host),
s0 AS MATERIALIZED (SELECT host, coalesce({1 - d} * a / nullif(sum(a) OVER (), 0), 0) AS trust, coalesce({1 - d} * b / nullif(sum(b) OVER (), 0), 0) AS distrust FROM h),
{", ".join(steps)}
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.verdict, CASE WHEN coalesce(x.distrust, 0) > coalesce(x.trust, 0) * {urlfilter.EXCESS} THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN s{urlfilter.ROUNDS} x ON x.host = r.host
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": _op2_sql(),
        "op5_source_mix": OP5_SQL,
        "op7_substring_dedup": OP7_SQL,
        "op11_minhash_components": OP11_SQL,
        "op12_ranked_search": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
