"""Cutting the lineage of iterative plans, and dealing out small files."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder that the cluster shares; make one only where none is set and all runs on one machine.

    Spark guesses the size of what comes out from the files that went in, which does not count
    what explodes made of them; so joins with it shuffle, unless the other side is a broadcast.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True).hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows of a small file to as many tasks as a shuffle has, by their keys.

    A file of a few MB is one task's, however much is derived from each of its rows.
    Joins shuffle, as after ``cut``.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).hint("merge")


def checkpoint_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where that is unset, a new folder, but only in local mode, whose tasks see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="meshlark-")
