"""IPv6 columns against Python's ipaddress, and allocation with 128-bit numbers."""

import ipaddress
import random

from pyspark.sql import functions as F

from meshlark.functions import ipv6

TEXTS = [
    "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8", "1:2:3:4::5:6:7:8", "1::2::3", ":::", "::::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::1",
    "fe80::1%eth0", " ::1", "::1 ", "", None, ":", "::ffff:1.2.3.4", "::FFFF:10.0.0.1", "::1.2.3.4", "64:ff9b::192.0.2.33", "1.2.3.4", "1.2.3.4::", "::1.2.3", "::1.2.3.256", "::01.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
    "2001:DB8:0:0:1:0:0:1", "2001:db8::1:0:0:0:1", "0:0:1::", "1:0:0:2:0:0:0:3", "ff02::1", "fe80::1", "febf::1", "fec0::1", "::ffff:127.0.0.1", "::ffff:224.0.0.9", "::ffff:169.254.7.7", "0:0:0:0:0:0:0:0", "00001::", "1:2.3.4.5", "::1\n", "10.0.0.1", "010.0.0.1", "1.2.3", "x",
]


def of(t):
    if not isinstance(t, str) or "%" in t or t != t.strip():
        return None
    try:
        return ipaddress.ip_address(t)
    except ValueError:
        return None


def facts(ip, p):
    if ip is None:
        return (None,) * 5
    if ip.version == 4:
        return (4, str(ip), ip.packed, None, None)
    bad = (None, None)
    if ip.is_unspecified or ip.is_loopback or ip.is_multicast:
        bad = ("reserved_ip", "error")
    elif p is not None and p <= 126 and ipaddress.IPv6Network((ip, p), strict=False).network_address == ip:
        bad = ("ip_is_network_address", "error")
    elif ip.is_link_local:
        bad = ("link_local_ip", "warning")
    return (6, str(ip), ip.packed, *bad)


def test_columns_equal_ipaddress(spark):
    rng = random.Random(7)
    texts = list(TEXTS)
    for _ in range(400):
        groups = [rng.choice(["0", "0", "0", "00", "1", "ab", "FFFF", f"{rng.randrange(65536):x}", f"{rng.randrange(256):04x}"]) for _ in range(8)]
        ip = ipaddress.IPv6Address(":".join(groups))
        texts += [":".join(groups), str(ip), str(ipaddress.IPv6Network((ip, rng.randrange(129)), strict=False).network_address)]
        at = rng.randrange(9)
        texts.append(":".join(groups[:at]) + "::" + ":".join(groups[at : at + rng.randrange(6)]))
    rows = [(i, t, rng.choice([None, *range(0, 129)]), rng.choice([None, 0, 1, rng.randrange(1 << 20), (1 << 62) + 5])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string, p int, v long")
    got = df.select("i", ipv6.ip_facts("t", "p").alias("f"), ipv6.network_of("t", "p").alias("n"), ipv6.canonical("t").alias("c"), ipv6.resolve_suffix("t", "p", "v").alias("r"), ipv6.network_range("t", "p").alias("g")).collect()
    for r in got:
        _, t, p, v = rows[r["i"]]
        ip = of(t)
        assert tuple(bytes(x) if isinstance(x, bytearray) else x for x in r["f"]) == facts(ip, p), (t, p)
        net = ipaddress.ip_network((ip, p), strict=False) if ip is not None and p is not None and p <= ip.max_prefixlen else None
        assert r["n"] == (str(net.network_address) if net else None), (t, p)
        assert r["c"] == (str(ip) if ip is not None and ip.version == 6 and int(ip) else None), t
        whole = net if net is not None and net.network_address == ip else None
        assert tuple(r["g"]) == ((f"{int(whole[0]):032x}", f"{int(whole[-1]):032x}", str(whole)) if whole is not None else (None,) * 3), (t, p)
        if ip is None or ip.version != 6 or p is None:
            want = (None, "invalid_network")
        elif p == 128:
            want = (None, "prefix_has_no_host_bits")
        elif whole is None:
            want = (None, "network_address_has_host_bits")
        elif v is None or v >= 1 << (128 - p):
            want = (None, "suffix_outside_network")
        else:
            want = (str(ipaddress.IPv6Address(int(ip) + v)), "resolved")
        assert tuple(r["r"]) == want, (t, p, v)


def test_no_python_worker(spark):
    df = spark.createDataFrame([("::1", 64)], "t string, p int").select(ipv6.ip_facts("t", "p"), ipv6.network_of("t", "p"))
    assert "Python" not in df._jdf.queryExecution().toString()
