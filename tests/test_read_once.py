"""What is dear to derive is derived once, however often it is read."""

import contextlib
import io
import re

import pytest

from meshlark.operators import fusion, graph, readiness, validation
from meshlark.plans import entries, lineage, planted, scenes, values


def _counted(df):
    """The same rows, and how many of them were derived, over all reads."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [lineage.cut(t) for t in planted.tables(spark, sf_dir)]


def test_segments_read_devices_and_links_once(documents):
    known = lineage.cut(validation._known(documents[0]))
    links = lineage.cut(validation.valid_links(documents[1], known))
    want = {tuple(r) for r in graph.segments(known, links)[0].collect()}
    (known, devices_seen), (links, links_seen) = _counted(known), _counted(links)
    found, placed = graph.segments(known, links)
    assert {tuple(r) for r in found.collect()} == want and placed.count()
    read = devices_seen.value, links_seen.value
    assert read == (known.count(), links.count())


def test_planted_tables_are_compiled(spark, sf_dir):
    """The JVM leaves methods of over 8,000 bytes to its interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        devices, links = planted.tables(spark, sf_dir)
        for rows in (devices, links, validation._known(devices)):
            shown = io.StringIO()
            with contextlib.redirect_stdout(shown):
                rows.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def _largest_method(df):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())))


def test_readiness_rules_are_compiled(spark, documents):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        devices, links = readiness.device_rows(documents[0]), readiness.link_rows(documents[1])
        ends = readiness._ends(links, readiness._known(devices))
        stored = [lineage.cut(df) for df in (devices, links, ends)]
        found = readiness.device_findings(stored[0]), readiness.link_findings(*stored[1:]), readiness.graph_findings(readiness._known(stored[0]), stored[2])
        assert all(_largest_method(df) < 8000 for df in (devices, links, ends, *found))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_parsed_documents_are_derived_once(spark, sf_dir, documents, monkeypatch):
    rows, seen = zip(*[_counted(t) for t in documents], strict=True)
    monkeypatch.setattr(planted, "tables", lambda *_: rows)
    assert values.parsed_readiness(spark, sf_dir).count()
    assert [s.value for s in seen] == [t.count() for t in documents]


def test_raw_documents_are_derived_once(spark, sf_dir, documents, monkeypatch):
    rows, seen = zip(*[_counted(t) for t in documents], strict=True)
    monkeypatch.setattr(planted, "tables", lambda *_: rows)
    assert entries.raw_readiness(spark, sf_dir).count()
    assert [s.value for s in seen] == [t.count() for t in documents]


def test_cables_are_matched_once_for_links_and_refusals(spark, sf_dir):
    devices, _, cables = scenes.drawings(spark, sf_dir)
    cables, seen = _counted(lineage.cut(cables))
    good, refused = fusion.links(cables, devices)
    read = seen.value
    assert good.count() and refused.count() and seen.value == read > 0


def test_an_item_without_an_id_is_no_repeat(spark):
    rows = spark.createDataFrame([("a", p, True, i) for p, i in enumerate(["x", None, "x", " ", None, "x"])] + [("b", 0, True, "x"), ("a", 6, False, "x")], "arch_id string, pos int, is_object boolean, id string")
    assert {(r.arch_id, r.pos): r.nth for r in readiness.first_ids(rows).collect()} == {("a", 0): 0, ("a", 1): None, ("a", 2): 1, ("a", 3): None, ("a", 4): None, ("a", 5): 2, ("b", 0): 0, ("a", 6): None}


def test_findings_written_twice_are_found_once(spark, sf_dir, documents, monkeypatch):
    rows, seen = zip(*[_counted(t) for t in documents], strict=True)
    readiness.check(*rows).write.format("noop").mode("overwrite").save()
    once = [s.value for s in seen]
    monkeypatch.setattr(planted, "tables", lambda *_: rows)
    assert values.written_findings(spark, sf_dir).count()
    twice = [s.value for s in seen]
    assert all(n - m <= m for n, m in zip(twice, once, strict=True))


def test_readdressed_devices_are_derived_once(spark, sf_dir, documents, monkeypatch):
    devices, seen = _counted(documents[0])
    monkeypatch.setattr(planted, "tables", lambda *_: (devices, documents[1]))
    entries.readdressed_documents(spark, sf_dir)
    assert seen.value == documents[0].count()
