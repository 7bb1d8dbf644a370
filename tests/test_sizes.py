"""Plans that hold for large tables: small files are dealt out, joins do not rest on guesses of size, ties go as in SQL."""

import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from meshlark.functions import addr
from meshlark.operators import contracts, grouping, search
from meshlark.plans import answers, catalogue, lineage, planted, scenes, values
from meshlark.sources import cards


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_small_files_are_dealt_out_and_joined_by_shuffles(spark, sf_dir, capsys):
    texts = scenes._texts(spark, sf_dir)
    assert texts.rdd.getNumPartitions() == 4
    assert "BroadcastHashJoin" not in _plan(grouping.scored_pairs(texts.withColumn("slot", texts["kind"])), capsys)


def test_joins_of_cut_tables_shuffle(spark, capsys):
    ids = lineage.cut(spark.range(9))
    assert "BroadcastHashJoin" not in _plan(ids.join(spark.range(9), "id"), capsys)


def test_cables_go_in_batches_of_images(spark, sf_dir, capsys):
    assert "CoGroup" not in _plan(scenes.merged_cables(spark, sf_dir), capsys)


def test_parts_of_plans_are_joined_by_shuffles(spark, sf_dir, capsys):
    assert "BroadcastHashJoin" not in _plan(answers.plan_documents(spark, sf_dir), capsys)


def test_nearest_segment_of_equal_ones_is_the_first(spark, tmp_path):
    pq.write_table(pa.table({"p_partkey": pa.array([91881], pa.int64()), "p_size": pa.array([26], pa.int32())}), tmp_path / "part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    rows = db.execute(f"SELECT nearest, nearest_at FROM ({catalogue.oracle_sql()['segment_geometry']})").fetchall()
    assert [tuple(r) for r in values.segment_geometry(spark, str(tmp_path)).select("nearest", "nearest_at").collect()] == rows


def test_a_ray_that_touches_a_corner_enters_as_in_sql(spark, tmp_path):
    pq.write_table(pa.table({"p_partkey": pa.array([44843, 56356], pa.int64()), "p_size": pa.array([27, 37], pa.int32())}), tmp_path / "part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    rows = db.execute(f"SELECT k, entry FROM ({catalogue.oracle_sql()['segment_geometry']}) ORDER BY k").fetchall()
    assert [tuple(r) for r in values.segment_geometry(spark, str(tmp_path)).select("k", "entry").orderBy("k").collect()] == rows
    assert all(entry is not None for _, entry in rows)


def test_a_prefixed_address_is_matched_once(spark):
    df = spark.createDataFrame([("192.168.1.9/24",), ("192.168.1.9",), (None,)], "t string").select(addr.normalize_cidr(F.col("t")).alias("c"))
    assert df._jdf.queryExecution().toString().split("== Physical")[0].count("RLIKE") < 10
    assert [r.c and (r.c.ip_address, r.c.prefix_length, r.c.subnet_mask, r.c.network_address) for r in df.collect()] == [("192.168.1.9", 24, "255.255.255.0", "192.168.1.0"), None, None]


def test_short_ids_need_no_image_in_one_place(spark, capsys):
    rows = spark.createDataFrame([(1, "a_01"), (1, "a_1"), (1, "b_02"), (2, "a_01"), (2, None), (None, "c_03"), (None, "c_3")], "image_id int, id string")
    out = contracts.short_ids(rows)
    assert "Window" not in _plan(out, capsys)
    assert {(r.image_id, r.id): r.short for r in out.collect()} == {(1, "a_01"): "a_01", (1, "a_1"): "a_1", (1, "b_02"): "b_02", (2, "a_01"): "a_1", (2, None): None, (None, "c_03"): "c_03", (None, "c_3"): "c_3"}


def test_dense_search_holds_few_scores_at_once():
    rng = np.random.default_rng(1)
    batch = pd.DataFrame({"id": np.arange(5000), "v": list(rng.normal(size=(5000, 4)))})
    asked = rng.normal(size=(2000, 4))
    tracemalloc.start()
    out = pd.concat(search._best_of(np.arange(2000), search._unit_rows(list(asked)), 3, "id", "q", "v")([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    scores = np.round(search._unit_rows(list(asked)) @ search._unit_rows(batch["v"]).T, 12)
    assert out.groupby("q")["id"].apply(set).tolist() == [set(r) for r in np.argsort(-scores, axis=1, kind="stable")[:, :3]]


def test_cards_are_cut_in_small_batches(spark, capsys):
    files = spark.createDataFrame([("a", "# x\nbody\n# y"), ("b", None)], "source string, content string")
    assert "MapInArrow" in _plan(cards.chunks(files), capsys)
    assert [tuple(r) for r in cards.chunks(files).orderBy("source", "chunk").collect()] == [("a", 0, "# x", "# x\nbody"), ("a", 1, "# y", "# y")]


def test_planted_documents_are_dealt_out(spark, sf_dir):
    assert all(t.rdd.getNumPartitions() > 1 for t in planted.tables(spark, sf_dir))
