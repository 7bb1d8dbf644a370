"""Addresses are parsed once, however many of their facts are read."""

from pyspark.sql import functions as F

from meshlark.operators import validation


def test_an_ipv6_address_is_parsed_once(spark):
    rows = spark.createDataFrame([("2001:DB8:0:0:1::2", 64), ("::ffff:10.0.0.1", 128), ("fe80::1", 64), ("10.0.0.1", 24), ("1::2::3", 64), ("::", 64), (None, 64), ("2001:db8::7", None)], "t string, p int")
    out = rows.select("t", validation._address(6, F.struct(F.lit("STRING").alias("kind"), F.col("t").alias("text")), F.col("p")).alias("a"), validation._hex_of(6, F.col("t")).alias("hex"))
    parses = out._jdf.queryExecution().optimizedPlan().toString().count("[0-9A-Fa-f:.]+")
    assert parses == 2  # the address, and the digits of another
    got = {r["t"]: (tuple(r["a"]), r["hex"]) for r in out.collect()}
    assert got["2001:DB8:0:0:1::2"] == (("2001:db8::1:0:0:2", "2001:db8::", None, None, 6), "20010db8000000000001000000000002")
    assert got["fe80::1"][0] == ("fe80::1", "fe80::", "link_local_ip", "warning", 6)
    assert got["::"][0] == ("::", "::", "reserved_ip", "error", 6)
    assert got["10.0.0.1"] == ((None, None, None, None, 4), None)
    assert got["1::2::3"] == ((None,) * 5, None) and got[None] == ((None,) * 5, None)
    assert got["2001:db8::7"][0] == ("2001:db8::7", None, None, None, 6)
    assert got["::ffff:10.0.0.1"][0][:2] == ("::ffff:10.0.0.1", "::ffff:10.0.0.1")
