"""The corpus pipeline: stages over ``documents``, each written and read again by the caller.

Each stage works on all rows that its predecessor kept and, but for the last, returns
the columns of ``documents``; columns beside these are dropped, whatever they are called.
An empty table gives an empty one.  Texts are read whole, however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import decontam, langid, mixing, near, sharding
from meshlark.llm.common import store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose language is less likely than this, or which has none, goes.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language; learned from labelled rows that are not held out.

    A null or empty text, or one without a letter, has none and goes; null ids, languages
    and sources do not matter.  Each row is judged by its text alone, so repeated rows
    stay or go together.  Ties go to the language that sorts first.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model, COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: links are a similarity of 0.8 or more of the sets of five-word shingles.

    SimHash fingerprints find the candidates, the whole sets decide.  The row with the
    smallest id stays, null ids come last; of rows that repeat it and its text, one.  Each
    row is judged by its own text, so other texts under a shared or null id stay.  A null
    or blank text has no words, and such texts are copies of each other.
    """
    return near.keep_one(docs, COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item; rows without an id are judged by their texts.

    Rows that share an id are one document and go together.  A null or empty text holds
    nothing and stays; an empty benchmark keeps all.
    """
    docs = docs.select(*COLUMNS)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontam.contaminated(docs, bench).select("doc_id").distinct()
    kept = docs.join(leaks, "doc_id", "left_anti")
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept
    key = F.xxhash64("text")
    leaks = decontam.contaminated(nameless.select(key.alias("doc_id"), "text"), bench).select(F.col("doc_id").alias("_gone")).distinct()
    return kept.where("doc_id is not null").unionByName(nameless.join(leaks, key == leaks["_gone"], "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that sources weigh the square root of their size, in shuffled order.

    A null source is a source of its own, a null id an id like any other; rows that repeat
    an id are repeated alike.  Texts are only carried, so null, empty and long ones are no case of their own.
    """
    docs = docs.select(*COLUMNS)
    return mixing.replicate(docs, mixing.source_rates(docs)).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all rows on shards of even counts, equal texts together.

    A null text is linked to none and counts 8 bytes; repeated rows are equal texts.  A
    group of more than half a shard is cut by hash.  Ties within a shard go by id, text and size.
    """
    return sharding.assign_shards(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]
#: Fingerprints and learned probabilities have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what one returns is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, store(docs) if i else docs, sf_dir)
    return docs
