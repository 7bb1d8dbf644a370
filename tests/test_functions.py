"""Column functions against tables of known values and against plain Python."""

import ipaddress
import math
import random

import pytest
from pyspark.sql import functions as F

from meshlark.functions import addr, ipv6, scores, text
from meshlark.functions import geometry as G


def column(spark, values, kind, **made):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {kind}")
    return [tuple(r) for r in df.orderBy("i").select(*[c.alias(n) for n, c in made.items()]).collect()]


def test_addresses_are_strict_and_go_round(spark):
    rng = random.Random(1)
    good = [str(ipaddress.IPv4Address(rng.randrange(1 << 32))) for _ in range(100)] + ["0.0.0.0", "255.255.255.255"]
    bad = ["", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "1.2.3.4 ", "a.b.c.d", "1.2.3.4\n", None, "1..2.3", "999.1.1.1"]
    out = column(spark, good + bad, "a string", v=addr.ip_to_int(F.col("a")), t=addr.int_to_ip(addr.ip_to_int(F.col("a"))))
    assert out[: len(good)] == [(int(ipaddress.IPv4Address(a)), a) for a in good]
    assert out[len(good) :] == [(None, None)] * len(bad)


def test_masks(spark):
    masks = [str(ipaddress.IPv4Network((0, p)).netmask) for p in range(33)]
    rows = [(m, p) for p, m in enumerate(masks)]
    out = column(spark, rows, "m string, p int", a=addr.mask_to_prefix(F.col("m")), z=addr.mask_to_prefix(F.col("m"), True), m=addr.prefix_to_mask(F.col("p")))
    assert out == [(p or None, p, m) for p, m in enumerate(masks)]
    odd = ["255.0.255.0", "0.0.0.255", "255.255.255.1", "x", None]
    assert column(spark, odd, "m string", a=addr.mask_to_prefix(F.col("m"), True)) == [(None,)] * 5
    assert column(spark, [-1, 33, None], "p int", a=addr.mask_of(F.col("p"))) == [(None,)] * 3


def test_networks_and_hosts(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(1 << 32), rng.randrange(33)) for _ in range(300)]
    p, i = F.col("p"), F.col("i2")
    out = column(spark, rows, "i2 long, p int", n=addr.network_of(i, p), b=addr.broadcast_of(i, p), u=addr.usable_hosts(p), c=addr.host_problem(i, p)["code"], f=addr.is_network_form(i, p))
    for (v, prefix), (n, b, u, c, form) in zip(rows, out, strict=True):
        net = ipaddress.ip_network((v, prefix), strict=False)
        ip = ipaddress.IPv4Address(v)
        assert (n, b) == (int(net[0]), int(net[-1]))
        assert u == {32: 1, 31: 2}.get(prefix, net.num_addresses - 2)
        assert form == (prefix <= 30 and ip == net[0])
        if ip.is_loopback or ip.is_multicast or v >> 24 == 0 or v >> 28 == 15:
            assert c in ("reserved_ip", "ip_looks_like_mask")
        elif prefix <= 30 and ip == net[0]:
            assert c == "ip_is_network_address"
        elif prefix <= 30 and ip == net[-1]:
            assert c == "ip_is_broadcast_address"
    need = column(spark, [0, 1, 2, 3, 6, 7, 254, 255, 65534], "h int", p=addr.smallest_prefix(F.greatest(F.col("h"), F.lit(1))))
    assert [x[0] for x in need] == [30, 30, 30, 29, 29, 28, 24, 23, 16]


SUFFIXES = [
    ("192.168.1.0", 24, ".2", "192.168.1.2", "resolved"),
    ("192.168.1.0", 24, "2", None, "invalid_host_suffix"),
    ("192.168.1.0", 24, ".256", None, "invalid_host_suffix"),
    ("nonsense", 24, ".2", None, "invalid_network"),
    ("192.168.1.0", 24, "::2", None, "suffix_family_mismatch"),
    ("10.10.0.0", 16, ".20", None, "prefix_outside_final_octet_range"),
    ("192.168.1.4", 24, ".2", None, "network_address_has_host_bits"),
    ("192.168.1.0", 25, ".200", None, "suffix_outside_network"),
    ("192.168.1.0", 24, ".0", None, "suffix_is_network_or_broadcast_address"),
    ("192.168.1.0", 24, ".255", None, "suffix_is_network_or_broadcast_address"),
    ("192.168.1.0", 31, ".0", "192.168.1.0", "resolved"),
]


def test_host_suffixes(spark):
    got = addr.resolve_host_suffix(F.col("n"), F.col("p"), F.col("s"))
    assert column(spark, [x[:3] for x in SUFFIXES], "n string, p int, s string", a=got["address"], r=got["reason"]) == [x[3:] for x in SUFFIXES]
    six = [("2001:db8:1::", 64, 2, "2001:db8:1::2", "resolved"), ("2001:db8:1::", 128, 2, None, "prefix_has_no_host_bits"), ("2001:db8:1::1", 64, 2, None, "network_address_has_host_bits"), ("2001:db8:1::", 126, 9, None, "suffix_outside_network")]
    got = ipv6.resolve_suffix(F.col("n"), F.col("p"), F.col("v"))
    assert column(spark, [x[:3] for x in six], "n string, p int, v long", a=got["address"], r=got["reason"]) == [x[3:] for x in six]


def test_normalised_addresses(spark):
    c = addr.normalize_cidr(F.col("t"))
    out = column(spark, ["192.168.1.9/24", "10.0.0.1/33", "10.0.0.1/024", "10.0.0.1", None], "t string", i=c["ip_address"], p=c["prefix_length"], m=c["subnet_mask"], n=c["network_address"])
    assert out == [("192.168.1.9", 24, "255.255.255.0", "192.168.1.0")] + [(None,) * 4] * 4
    c = addr.normalize_ip_and_mask(F.col("t"), F.lit("255.255.0.0"))
    assert column(spark, ["10.1.2.3", "x"], "t string", n=c["network_address"], o=c["field_origin"]["prefix_length"]) == [("10.1.0.0", "derived_from_subnet_mask"), (None, None)]
    assert column(spark, ["2001:DB8::1", "::", "fe80::1%eth0", "10.0.0.1", "1::2::3", None], "t string", c=ipv6.canonical(F.col("t"))) == [("2001:db8::1",), (None,), (None,), (None,), (None,), (None,)]


def test_text(spark):
    out = column(spark, ["a", " ", " ", "", None], "t string", n=text.named(F.col("t")))
    assert out == [(True,), (False,), (False,), (False,), (False,)]
    strings = ["R1", "it's", 'say "x"', "both ' and \"", "back\\slash"]
    assert column(spark, strings, "t string", q=text.quoted(F.col("t"))) == [(repr(s),) for s in strings]
    assert column(spark, ["ＡＢ １　 2", None], "t string", n=text.normalize(F.col("t"))) == [("AB 1 2",), (None,)]
    assert column(spark, ["a/b~c"], "t string", p=text.pointer(F.col("t"))) == [("a~1b~0c",)]
    assert column(spark, ["x\nMode: all\nPhase: y"], "t string", m=text.card_field(F.col("t"), "Mode"), n=text.card_field(F.col("t"), "None")) == [("all", "")]


def test_combinations(spark):
    rows = [(0.9, 0.4, None), (None, None, None), (0.0, 0.5, None), (1.0, 1.0, 1.0)]
    out = [x[0] for x in column(spark, rows, "a double, b double, c double", s=scores.combine(F.col("a"), F.col("b"), F.col("c")))]
    assert math.isclose(out[0], 0.6) and out[1:] == [None, 0.0, 1.0]
    assert column(spark, [0.75, 0.7499, 0.55, 0.5, None], "s double", t=scores.tier(F.col("s"))) == [("accepted",), ("flagged",), ("flagged",), ("unresolved",), ("unresolved",)]


def plain_seg_rect(s, r, n=400):
    best = math.inf
    for k in range(n + 1):
        t = k / n
        x, y = s[0] + t * (s[2] - s[0]), s[1] + t * (s[3] - s[1])
        best = min(best, math.hypot(max(r[0] - x, 0, x - r[2]), max(r[1] - y, 0, y - r[3])))
    return best


@pytest.mark.parametrize("seed", [0, 1])
def test_segments_and_rectangles(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        a, b = sorted(rng.uniform(0, 100) for _ in range(2)), sorted(rng.uniform(0, 100) for _ in range(2))
        s = [rng.uniform(0, 100) for _ in range(4)]
        if rng.random() < 0.2:
            s[2] = s[0]
        rows.append((*s, a[0], b[0], a[1], b[1]))
    seg = G.segment(G.point(F.col("a"), F.col("b")), G.point(F.col("c"), F.col("d")))
    box = G.rect(F.col("e"), F.col("f"), F.col("g"), F.col("h"))
    out = column(spark, rows, ", ".join(f"{x} double" for x in "abcdefgh"), d=G.seg_rect_distance(seg, box), c=G.clip_segment_to_rect(seg, box).isNotNull(), r=G.ray_rect_entry(seg["p1"], G.unit(seg["p1"], seg["p2"]), box))
    for row, (d, inside, ray) in zip(rows, out, strict=True):
        near = plain_seg_rect(row[:4], row[4:])
        length = math.dist(row[:2], row[2:4])
        assert d <= near + 1e-9 and near <= d + length / 400 + 1e-9
        assert inside == (d == 0)
        if inside:
            assert ray is not None and ray <= length + 1e-9


def test_polylines_and_reading_order(spark):
    points = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (10, 0), (10, 10))])
    out = spark.range(1).select(G.polyline_length(points).alias("l"), G.polyline_midpoint(points).alias("m"), G.rect_polyline(G.rect(F.lit(12), F.lit(4), F.lit(14), F.lit(6)), G.polyline_segments(points)).alias("d")).first()
    assert out["l"] == 20 and tuple(out["m"]) == (10, 0) and tuple(out["d"]) == (2, 1)
    rng = random.Random(5)
    for _ in range(5):
        items = [(f"t{i}", *(x := (rng.uniform(0, 200), rng.uniform(0, 80))), x[0] + 20, x[1] + rng.uniform(5, 15)) for i in range(12)]
        heights = sorted(i[4] - i[2] for i in items)
        band, rows = max(8.0, heights[6] * 0.5), []
        for i in sorted(items, key=lambda i: ((i[2] + i[4]) / 2, (i[1] + i[3]) / 2, i[0])):
            cy = (i[2] + i[4]) / 2
            if rows and abs(cy - rows[-1][0]) <= band:
                rows[-1][1].append(i)
            else:
                rows.append((cy, [i]))
        want = [i[0] for _, r in rows for i in sorted(r, key=lambda i: ((i[1] + i[3]) / 2, i[0]))]
        df = spark.createDataFrame(items, "id string, a double, b double, c double, d double").select(F.struct("id", G.rect(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box")).alias("x"))
        assert df.agg(G.reading_order(F.collect_list("x")).alias("o")).first()["o"] == want
