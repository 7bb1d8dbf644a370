"""What a Python worker holds, whatever it reads."""

import tracemalloc

import numpy as np
import pyarrow as pa

from meshlark.llm import common, decontam, langid
from meshlark.llm.common import Powers, text_buffer


def test_powers_are_not_twice_as_many_as_asked_for():
    powers = Powers()
    powers.need((1 << 20) + 1)
    assert (1 << 20) + 1 <= len(powers.up) <= 1.13 * (1 << 20) and len(powers.down) == len(powers.up)
    at = np.array([0, 1, 777, (1 << 20)])
    assert [int(x) for x in powers.up[at]] == [pow(common.BASE, int(i), 1 << 64) for i in at]
    assert [int(x) for x in powers.down[at]] == [pow(common.BASE_INVERSE, int(i), 1 << 64) for i in at]


def test_a_text_goes_to_python_once(spark):
    docs = spark.createDataFrame([(1, "guten Tag", "de"), (2, None, "de"), (3, "ÉTÉ d'été", "fr")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    out = langid.predict(docs, model, ["doc_id", "text", "lang"])
    assert "_text" not in out._jdf.queryExecution().optimizedPlan().toString()
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()} == plain and plain[2] == ("und", 0.0)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "guten Tag", 2: None, 3: "ÉTÉ d'été"}


def test_windows_of_a_narrow_chunk_need_little_memory():
    text = "The Quick brown fox jumps over 12 lazy dogs near Paris and Rome today. " * 60_000
    data, offsets = text_buffer(pa.array([text[i : i + 710] for i in range(0, len(text), 710)]))
    common.POWERS.need(1 << 20)
    tracemalloc.start()
    for a, b in common.chunks(offsets, common.NARROW_BYTES):
        words, surface, fixed, capital, name, rows = decontam.canonical(data, offsets[a : b + 1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
