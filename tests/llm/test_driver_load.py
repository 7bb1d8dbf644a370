"""What a fixed point asks of the driver: it keeps a record of every task that it ever started."""

from __future__ import annotations

import uuid

from meshlark.llm.graph import components


def test_a_round_of_stars_starts_few_tasks(spark):
    """A cycle of 40 nodes: 504 tasks on 8 partitions, 728 with a union of both directions and one shuffle more in each round."""
    sc, name = spark.sparkContext, uuid.uuid4().hex
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    links = spark.createDataFrame([(i, (i + 1) % 40) for i in range(40)], "a long, b long").repartition(4)
    sc.setJobGroup(name, "components")
    try:
        found = {(r["node"], r["root"]) for r in components(links).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found == {(i, 0) for i in range(40)}
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s)))
    assert tasks <= 600, tasks
