"""The rules over a stream of documents.

Each micro-batch goes through the same operators as a table would, and findings
are appended under the batch's number, so that a repeated batch replaces its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import readiness
from ..sources import topology


def documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (arch_id, raw) from JSON files that arrive under ``path``."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select(F.input_file_name().alias("arch_id"), F.col("value").alias("raw"))


def check_stream(raw: DataFrame, out: str, checkpoint: str, rules: Callable = readiness.check, once: bool = False) -> StreamingQuery:
    """Findings of a stream of documents, a folder for each batch under ``out``."""

    def batch(rows: DataFrame, number: int) -> None:
        docs = topology.parse(rows)
        found = rules(topology.devices(docs), topology.links(docs), topology.headers(docs))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
