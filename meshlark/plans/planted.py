"""Topology documents with planted faults, one small document for each customer, and both rule sets over them.

The number of a document modulo CASES says what is wrong with it; 0 is without fault.  The
SQL states each rule anew over the flat tables, so that it knows nothing of the plan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings, readiness, validation
from .lineage import spread
from .views import DIALECT, dotted

CASES = 61
#: Columns of a block that come with a JSON kind.
DEVICE4, DEVICE6 = ("ip", "prefix", "mask", "base"), ("ip6", "prefix6", "mask6", "base6")
FIELD = {"ip": "ip_address", "prefix": "prefix_length", "mask": "subnet_mask", "base": "network_address", "source_ip": "source_ip", "target_ip": "target_ip"}


def _bytes(number: str) -> str:
    """``dotted`` for Spark, without divisions, each of which comes with checks."""
    parts = f"shiftright({number}, 24)", f"shiftright({number}, 16) & 255", f"shiftright({number}, 8) & 255", f"({number}) & 255"
    return "concat(" + ", '.', ".join(f"CAST({p} AS STRING)" for p in parts) + ")"


class _Address(NamedTuple):
    """A BIGINT expression to be shown as a dotted address, NULL unless ``when`` holds."""

    value: str
    when: str | None = None

    def sql(self, shown: str) -> str:
        return f"CASE WHEN {self.when} THEN {shown} END" if self.when else shown


def _cases(column: str, cases: dict, default: str, dialect: str) -> str:
    """cases: (number, pos) -> SQL text."""
    at = "f = {} AND pos = {}".format if dialect == "duckdb" else lambda f, pos: f"place = {8 * f + pos}"
    whens = " ".join(f"WHEN {at(*case)} THEN {value}" for case, value in cases.items())
    return f"CASE {whens} ELSE {default} END AS {column}" if cases else f"{default} AS {column}"


def _fields(text: dict[str, dict], default: dict, dialect: str) -> tuple[list[str], list[str]]:
    """Columns of numbers that the rows need first, and a ``_text`` column for each field.

    For Spark a field's addresses are numbers first and dotted once: with a dotted form
    for each case the generated method is too large for the JVM to compile.
    """
    numbers, fields = [], []
    is_address = lambda v: isinstance(v, _Address)
    for n in default:
        if dialect == "duckdb":
            shown = lambda v: v.sql(dotted(v.value, dialect)) if is_address(v) else v
            fields.append(_cases(f"{n}_text", {at: shown(v) for at, v in text[n].items()}, shown(default[n]), dialect))
        elif not any(is_address(v) for v in (default[n], *text[n].values())):
            fields.append(_cases(f"{n}_text", text[n], default[n], dialect))
        else:  # what is no address by default is NULL
            numbers.append(_cases(f"{n}_no", {at: v.sql(v.value) for at, v in text[n].items() if is_address(v)}, default[n].sql(default[n].value) if is_address(default[n]) else default[n], dialect))
            fields.append(_cases(f"{n}_text", {at: v for at, v in text[n].items() if not is_address(v)}, _bytes(f"{n}_no"), dialect))
    return numbers, fields


def _documents(dialect: str) -> tuple[str, dict[str, str]]:
    """The documents (k, f, p), and SQL for their start, group and parity, which for Spark are columns, as is their mask."""
    c = _common(dialect)
    rows = f"SELECT c_custkey AS k, CAST(c_custkey % {CASES} AS INT) AS f, CAST(CASE WHEN c_custkey % {CASES} = 59 THEN 30 ELSE 20 + c_custkey % 7 END AS INT) AS p FROM customer"
    if dialect == "duckdb":
        return rows, c
    return f"SELECT *, {c['start']} AS first_ip, {c['group']} AS first_ip6, {_bytes("4294967296 - shiftleft(CAST(1 AS BIGINT), 32 - p)")} AS own_mask, {c['even']} AS even FROM ({rows}) k", c | {"start": "first_ip", "group": "first_ip6", "even": "even"}


def _numbered(case: str, numbers: list[str]) -> str:
    return f"(SELECT *, {', '.join(numbers)} FROM (SELECT *, coalesce(8 * f + pos, -1) AS place FROM {case}) x) n" if numbers else case


def _common(dialect: str) -> dict[str, str]:
    s = DIALECT[dialect]["str"]
    low_hex = "lower(hex({0}))" if dialect == "spark" else "lower(to_hex({0}))"
    return {"s": s, "group": f"concat('2001:db8:', {low_hex.format('(k % 60000 + 4096)')}, '::')", "start": "(167772160 + k % 4000 * CAST(4096 AS BIGINT))", "even": "k % 2 = 0"}


def _shown(names: tuple[str, ...], dialect: str) -> list[str]:
    """The fields of both blocks, NULL where there is no block; ``tables`` drops those blocks whole."""
    if dialect == "spark":
        return [f"{n}_text AS {n}" for n in names]
    return [f"CASE WHEN is_object AND {'has_net6' if n.endswith('6') else 'has_net'} THEN {n}_text END AS {n}" for n in names]


def devices_sql(dialect: str) -> str:
    """(k, f, p, pos, is_object, id, name, type, has_net, has_net6, a column and a kind for each field of both blocks)."""
    documents, c = _documents(dialect)
    s, start, group = c["s"], c["start"], c["group"]
    ip = lambda v: _Address(f"({start} + {v})")
    host, bit = "pos <> 1" if dialect == "spark" else "role <> 'switch'", "shiftleft(CAST(1 AS BIGINT), 32 - p)" if dialect == "spark" else "(1::BIGINT << (32 - p))"
    mask = "own_mask" if dialect == "spark" else dotted(f"(4294967296 - {bit})", dialect)
    own = lambda v: _Address(v.value, host) if isinstance(v, _Address) else f"CASE WHEN {host} THEN {v} END"
    text = {"ip": {(9, 2): "NULL", (10, 2): "'10.0.0.256'", (11, 2): "'7'", (12, 2): "'010.0.0.1'", (13, 2): ip("0"), (14, 2): ip(f"{bit} - 1"), (15, 2): "'127.0.0.1'", (16, 2): "'255.255.255.0'", (17, 2): "'169.254.1.2'", (18, 2): ip("1"), (19, 2): ip("10")}}
    text["prefix"] = {(20, 2): "NULL", (21, 2): "'33'", (22, 2): "'24'", (23, 2): "'24.0'"}
    text["mask"] = {(24, 2): "NULL", (25, 2): "'255.0.255.0'", (26, 2): "'abc'", (27, 2): "'255.255.255.252'", (28, 2): "'5'"}
    text["base"] = {(29, 2): "NULL", (30, 2): ip("1"), (31, 2): "'x.y'"}
    text["ip6"] = {(32, 2): f"concat(upper({group}), '3')", (33, 2): "'::1'", (34, 2): "'fe80::1'", (35, 2): "'zzz'", (36, 2): "'10.0.0.1'", (40, 2): group}
    text["prefix6"], text["mask6"], text["base6"] = {(38, 2): "'129'"}, {(37, 2): "'255.255.0.0'"}, {(39, 2): "'2001:db8:ffff::'"}
    default = {"ip": own(ip("1 + pos")), "prefix": own(f"CAST(p AS {s})"), "mask": own(mask), "base": own(ip("0")), "ip6": f"concat({group}, CAST(1 + pos AS {s}))", "prefix6": "'64'", "mask6": "NULL", "base6": group}
    kind = {"ip": {(11, 2): "'BIGINT'"}, "prefix": {(22, 2): "'STRING'", (23, 2): "'DECIMAL'"}, "mask": {(28, 2): "'BIGINT'"}}
    numbers, fields = _fields(text, default, dialect)
    kinds = [_cases(f"{n}_kind", kind.get(n, {}), "'BIGINT'" if n.startswith("prefix") else "'STRING'", dialect) for n in (*DEVICE4, *DEVICE6)]
    case = f"""({documents}) c
CROSS JOIN (SELECT 0 AS pos, 'r' AS key, 'router' AS role UNION ALL SELECT 1, 'sw', 'switch' UNION ALL SELECT 2, 'pc1', 'pc' UNION ALL SELECT 3, 'pc2', 'pc' UNION ALL SELECT 4, 'srv', 'server') r"""
    inner = f"""SELECT k, f, p, pos, NOT (f = 1 AND pos = 4) AS is_object, {_cases("id", {(2, 4): "NULL", (3, 4): "'pc1'", (4, 3): "'  '"}, "key", dialect)}, {_cases("name", {(5, 2): "NULL", (6, 3): "' pC1 '"}, "upper(key)", dialect)},
 {_cases("type", {(7, 2): "NULL"}, "role", dialect)}, NOT (f = 8 AND pos = 2) AS has_net, {c["even"]} AND {host} AS has_net6, {", ".join(fields)}, {", ".join(kinds)}
FROM {_numbered(case, numbers)}"""
    gone = lambda c, on: f"CASE WHEN is_object AND {on} THEN {c} END AS {c}"
    shown = _shown((*DEVICE4, *DEVICE6), dialect)
    if dialect == "spark":
        known = [f"CASE WHEN {n}_text IS NOT NULL THEN {n}_kind END AS {n}_kind" for n in (*DEVICE4, *DEVICE6)]
    else:
        known = [f"CASE WHEN is_object AND {'has_net6' if n.endswith('6') else 'has_net'} AND {n}_text IS NOT NULL THEN {n}_kind END AS {n}_kind" for n in (*DEVICE4, *DEVICE6)]
    return f"SELECT k, f, p, pos, is_object, {gone('id', 'true')}, {gone('name', 'true')}, {gone('type', 'true')}, is_object AND has_net AS has_net, is_object AND has_net6 AS has_net6, {', '.join([*shown, *known])} FROM ({inner}) d"


LINK4, LINK6 = ("base", "prefix", "mask", "source_ip", "target_ip"), ("base6", "prefix6", "mask6", "source_ip6", "target_ip6")


def links_sql(dialect: str) -> str:
    """(k, f, p, pos, is_object, id, source, target, has_net, has_net6, the fields of both blocks and their kinds)."""
    documents, c = _documents(dialect)
    s, start, group = c["s"], c["start"], c["group"]
    ip = lambda v: _Address(f"({start} + {v})")
    bit = "shiftleft(CAST(1 AS BIGINT), 32 - p)" if dialect == "spark" else "(1::BIGINT << (32 - p))"
    far = "16777216"  # a network of its own, 11.x
    place = "CASE pos WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END"
    text = {
        "base": {(47, 3): "NULL", (48, 3): ip("1"), (49, 3): "'x'", (56, 3): ip(far), (57, 3): ip(far)}, "prefix": {(50, 3): "NULL", (51, 3): "'40'"}, "mask": {(52, 3): "'255.255.255.252'"},
        "source_ip": {(53, 3): "NULL", (54, 3): "'bad'", (55, 3): ip("12288"), (56, 3): ip(f"{far} + 5"), (57, 3): ip(f"{far} + 5")}, "target_ip": {(56, 2): ip("20"), (56, 3): ip(f"{far} + 20"), (60, 3): ip("1")},
        "base6": {}, "prefix6": {}, "mask6": {}, "source_ip6": {}, "target_ip6": {(60, 3): f"concat({group}, '1')"},
    }
    default = {"base": ip("0"), "prefix": f"CAST(p AS {s})", "mask": "own_mask" if dialect == "spark" else dotted(f"(4294967296 - {bit})", dialect), "source_ip": ip(f"1 + {place}"), "target_ip": "NULL", "base6": group, "prefix6": "'64'", "mask6": "NULL", "source_ip6": f"concat({group}, CAST(1 + {place} AS {s}))", "target_ip6": "NULL"}
    numbers, fields = _fields(text, default, dialect)
    case = f"""({documents}) c
CROSS JOIN (SELECT 0 AS pos, 'r' AS source_key UNION ALL SELECT 1, 'pc1' UNION ALL SELECT 2, 'pc2' UNION ALL SELECT 3, 'srv') r"""
    inner = f"""SELECT k, f, p, pos, NOT (f = 45 AND pos = 3) AS is_object, {_cases("id", {(41, 3): "NULL", (42, 3): "'l0'"}, f"concat('l', CAST(pos AS {s}))", dialect)}, {_cases("source", {(43, 3): "'nope'", (44, 3): "'sw'", (58, 3): "'pc1'"}, "source_key", dialect)},
 {_cases("target", {(60, 3): "'r'"}, "'sw'", dialect)}, NOT (f = 46 AND pos = 3) AS has_net, {c["even"]} AS has_net6, {", ".join(fields)}
FROM {_numbered(case, numbers)}"""
    gone = lambda c: f"CASE WHEN is_object THEN {c} END AS {c}"
    shown = _shown((*LINK4, *LINK6), dialect)
    return f"SELECT k, f, p, pos, is_object, {gone('id')}, {gone('source')}, {gone('target')}, is_object AND has_net AS has_net, is_object AND has_net6 AS has_net6, {', '.join(shown)} FROM ({inner}) l"


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Devices and links in the shape of ``sources.topology``."""
    customer = spread(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey")
    d, k = (spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=customer) for sql in (devices_sql("spark"), links_sql("spark")))

    def block(names: tuple[str, ...], kinds: bool, on: str) -> Column:
        kind = lambda n: F.col(f"{n}_kind") if kinds else F.when(F.col(n).isNotNull(), "BIGINT" if n.startswith("prefix") else "STRING")
        return F.when(F.col(on), F.struct(*[F.struct(kind(n).alias("kind"), F.col(n).alias("text")).alias(FIELD[n.removesuffix("6")]) for n in names]))

    devices = d.select(F.col("k").alias("arch_id"), "pos", "is_object", "id", "name", "type", block(DEVICE4, True, "has_net").alias("network"), block(DEVICE6, True, "has_net6").alias("network6"))
    links = k.select(F.col("k").alias("arch_id"), "pos", "is_object", "id", "source", "target", block(LINK4, False, "has_net").alias("network"), block(LINK6, False, "has_net6").alias("network6"))
    return devices, links


def validation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the stricter rules, both address families."""
    return validation.check(*tables(spark, sf_dir)).select("arch_id", "code", "severity", "path", "subject", "value")


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices, links = tables(spark, sf_dir)
    out = findings.summary(devices.select("arch_id").distinct(), validation.check(devices, links))
    return out.select("arch_id", "valid", "errors", "warnings", F.array_join(F.transform(F.map_entries("codes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("codes"))


def planted_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readiness findings of the same documents."""
    return readiness.check(*tables(spark, sf_dir)).select("arch_id", "code", "path")


# ------------------------------------------------------------------ the rules in SQL
OCTET = "(0|[1-9][0-9]{0,2})"


def _v4(x: str) -> str:
    parts = [f"TRY_CAST(split_part({x}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    value = " + ".join(f"{p} * {n}" for p, n in zip(parts, (16777216, 65536, 256, 1), strict=True))
    return f"CASE WHEN regexp_full_match({x}, '{OCTET}(\\.{OCTET}){{3}}') AND greatest({', '.join(parts)}) <= 255 THEN {value} END"


def _v6(x: str) -> str:
    return f"CASE WHEN regexp_full_match(lower({x}), '2001:db8:[0-9a-f]{{4}}::[0-9a-f]?') OR {x} IN ('::1', 'fe80::1') THEN lower({x}) END"


def _up(value: str, p: str) -> str:
    return f"({value} // (1::BIGINT << (32 - {p})) * (1::BIGINT << (32 - {p})))"


HOST4 = """CASE WHEN (4294967295 - i) & (4294967296 - i) = 0 AND bit_count(i) >= 8 THEN 'ip_looks_like_mask' WHEN i < 16777216 OR i >> 24 = 127 OR i >> 28 IN (14, 15) THEN 'reserved_ip' WHEN p <= 30 AND i % (1::BIGINT << (32 - p)) = 0 THEN 'ip_is_network_address'
 WHEN p <= 30 AND i % (1::BIGINT << (32 - p)) = (1::BIGINT << (32 - p)) - 1 THEN 'ip_is_broadcast_address' WHEN i >> 16 = 43518 THEN 'link_local_ip' END"""
HOST6 = "CASE WHEN i = '::1' THEN 'reserved_ip' WHEN p <= 126 AND ends_with(i, '::') THEN 'ip_is_network_address' WHEN i = 'fe80::1' THEN 'link_local_ip' END"
NAMED = lambda c: f"coalesce(regexp_matches({c}, '\\S'), false)"

TABLES = f"""
d0 AS ({devices_sql("duckdb")}), l0 AS ({links_sql("duckdb")}),
d AS MATERIALIZED (SELECT *, CASE WHEN is_object AND {NAMED("id")} THEN row_number() OVER (PARTITION BY k, is_object AND {NAMED("id")}, id ORDER BY pos) - 1 END AS nth, CASE WHEN {NAMED("id")} THEN id END AS who, coalesce(lower(type) IN ('switch', 'bridge', 'hub'), false) AS l2 FROM d0),
l AS MATERIALIZED (SELECT *, CASE WHEN is_object AND {NAMED("id")} THEN row_number() OVER (PARTITION BY k, is_object AND {NAMED("id")}, id ORDER BY pos) - 1 END AS nth FROM l0),
known AS MATERIALIZED (SELECT * FROM d WHERE nth = 0),
good AS MATERIALIZED (SELECT l.* FROM l JOIN known s ON s.k = l.k AND s.id = l.source JOIN known t ON t.k = l.k AND t.id = l.target WHERE l.nth = 0 AND l.source <> l.target)"""


def _device_fields(six: str) -> str:
    """(k, pos, who, nth, id, on, kinds and texts, p, i or a: the address, b: the base's canonical text, right: the base it should be)."""
    cols = ", ".join(f"{n}{six} AS {n}_t, {n}{six}_kind AS {n}_k" for n in DEVICE4)
    blank = " AND ".join(f"{n}_k IS NULL" for n in (DEVICE4 if not six else ("ip", "prefix", "base")))
    return f"""SELECT k, pos, who, nth, id, NOT (l2 AND {blank}) AS active, * EXCLUDE (k, pos, who, nth, id), CASE WHEN prefix_k = 'BIGINT' AND prefix_t::INT BETWEEN 0 AND {128 if six else 32} THEN prefix_t::INT END AS p
 FROM (SELECT k, pos, who, nth, id, l2, {cols} FROM d WHERE has_net{six})"""


FAMILY = {"": "network", "6": "network6"}


def _rows(source: str, cond: str, code: str, path: str, subject: str, value: str, severity: str = "'error'") -> str:
    return f"SELECT k, {code} AS code, {severity} AS severity, {path} AS path, {subject} AS subject, {value} AS value FROM {source} WHERE {cond}"


def _address_columns(six: str, text: str, kind: str, out: str) -> str:
    """canonical text and the code that keeps it from being a host's."""
    if six:
        return f"CASE WHEN {kind} = 'STRING' THEN {_v6(text)} END AS {out}"
    return f"CASE WHEN {kind} = 'STRING' AND ({_v4(text)}) IS NOT NULL THEN {text} END AS {out}"


def _severity(code: str) -> str:
    return f"CASE WHEN {code} = 'link_local_ip' THEN 'warning' ELSE 'error' END"


def _validation_sql() -> str:
    ctes, out = [TABLES.strip()], []
    at = lambda *steps: "concat('/devices/', pos" + "".join(f", '/{s}'" for s in steps) + ")"
    link = lambda *steps: "concat('/links/', pos" + "".join(f", '/{s}'" for s in steps) + ")"
    out += [
        _rows("d", "NOT is_object", "'invalid_device'", at(), "NULL", "NULL"), _rows("d", f"is_object AND NOT {NAMED('id')}", "'missing_device_id'", at("id"), "NULL", "NULL"), _rows("d", "nth > 0", "'duplicate_device_id'", at("id"), "who", "NULL"),
        _rows("d", f"is_object AND NOT {NAMED('name')}", "'missing_device_name'", at("name"), "who", "NULL"), _rows("d", f"is_object AND NOT {NAMED('type')}", "'missing_device_type'", at("type"), "who", "NULL"),
        _rows("d", "is_object AND NOT has_net", "'missing_device_network'", at("network"), "who", "NULL"),
        _rows("(SELECT *, count(*) OVER (PARTITION BY k, lower(trim(name))) AS n FROM known WHERE " + NAMED("name") + ")", "n > 1", "'duplicate_device_name'", at("name"), "id", "name"),
        _rows("l", "NOT is_object", "'invalid_link'", link(), "NULL", "NULL"), _rows("l", f"is_object AND NOT {NAMED('id')}", "'missing_link_id'", link("id"), "NULL", "NULL"), _rows("l", "nth > 0", "'duplicate_link_id'", link("id"), "id", "NULL"),
        *[_rows(f"l ANTI JOIN known ON known.k = l.k AND known.id = l.{s}", "is_object", "'unknown_device'", link(s), "CASE WHEN nth = 0 THEN id END", s) for s in ("source", "target")],
        _rows("l SEMI JOIN known ON known.k = l.k AND known.id = l.source", "source = target", "'self_link'", link(), "CASE WHEN nth = 0 THEN id END", "NULL"), _rows("l", "is_object AND NOT has_net", "'missing_link_network'", link("network"), "CASE WHEN nth = 0 THEN id END", "NULL"),
    ]
    uses, own, used, nets = [], [], [], []
    for six, block in FAMILY.items():
        top = 128 if six else 32
        base_of = (lambda a: f"CASE WHEN p IS NOT NULL THEN regexp_replace({a}, '::[0-9a-f]*$', '::') END") if six else (lambda a: f"CASE WHEN {a} IS NOT NULL AND p IS NOT NULL THEN {dotted(_up(f'({_v4(a)})', 'p'), 'duckdb')} END")
        host = (lambda a: f"(SELECT {HOST6} FROM (SELECT {a} AS i))") if six else (lambda a: f"(SELECT {HOST4} FROM (SELECT {_v4(a)} AS i))")
        # devices
        ctes.append(f"dv{six} AS MATERIALIZED (SELECT *, {base_of('a')} AS should, {host('a')} AS bad FROM (SELECT *, {_address_columns(six, 'ip_t', 'ip_k', 'a')}, {_address_columns(six, 'base_t', 'base_k', 'b')} FROM ({_device_fields(six)})))")
        rows, path = f"dv{six}", lambda field, block=block: at(block, field)
        needed = ("ip", "prefix", "base") if six else DEVICE4
        out += [_rows(rows, f"active AND {n}_k IS NULL", f"'missing_{FIELD[n]}'", path(FIELD[n]), "who", "NULL") for n in needed]
        out.append(_rows(rows, "active AND prefix_k IS NOT NULL AND p IS NULL", "'invalid_prefix_length'", path("prefix_length"), "who", "prefix_t"))
        if six:
            out.append(_rows(rows, "active AND mask_k IS NOT NULL", "'unexpected_subnet_mask'", path("subnet_mask"), "who", "mask_t"))
        else:
            m = f"(SELECT CASE WHEN mask_k = 'STRING' THEN {_v4('mask_t')} END AS m)"
            bits = "(CASE WHEN (4294967295 - m) & (4294967296 - m) = 0 THEN bit_count(m) END)"
            out.append(_rows(f"{rows} CROSS JOIN LATERAL {m} x", f"active AND mask_k IS NOT NULL AND {bits} IS NULL", "'invalid_subnet_mask'", path("subnet_mask"), "who", "mask_t"))
            out.append(_rows(f"{rows} CROSS JOIN LATERAL {m} x", f"active AND m IS NOT NULL AND p IS NOT NULL AND {bits} IS DISTINCT FROM p", "'subnet_mask_mismatch'", path("subnet_mask"), "who", "mask_t"))
        for n, a, code in (("ip", "a", "invalid_ip_address"), ("base", "b", "invalid_network_address")):
            out.append(_rows(rows, f"active AND {n}_k IS NOT NULL AND {a} IS NULL", f"'{code}'", path(FIELD[n]), "who", f"{n}_t"))
            out.append(_rows(rows, f"active AND {a} <> {n}_t", "'non_canonical_ip'", path(FIELD[n]), "who", f"{n}_t", "'warning'"))
        out.append(_rows(rows, "active AND b <> should", "'network_address_mismatch'", path("network_address"), "who", "base_t"))
        out.append(_rows(rows, "active AND bad IS NOT NULL", "bad", path("ip_address"), "who", "a", _severity("bad")))
        # links and their ends
        ctes.append(
            f"lk{six} AS MATERIALIZED (SELECT *, CASE WHEN b IS NOT NULL AND p IS NOT NULL AND {base_of('b')} = b THEN concat(b, '/', p) END AS net FROM (SELECT *, {_address_columns(six, f'base{six}', repr('STRING'), 'b')} FROM (SELECT * EXCLUDE (p), CASE WHEN prefix{six}::INT BETWEEN 0 AND {top} THEN prefix{six}::INT END AS p FROM l WHERE is_object AND has_net{six})))"
        )
        side = lambda s: f"SELECT lk{six}.*, '{s}' AS side, {s} AS device, {s}_ip{six} AS e, known.pos AS device_pos, known.l2 AS l2 FROM lk{six} LEFT JOIN known ON known.k = lk{six}.k AND known.id = lk{six}.{s}"  # noqa: B023, E731
        ctes.append(f"en{six} AS MATERIALIZED (SELECT *, {host('a')} AS bad FROM (SELECT *, {_address_columns(six, 'e', repr('STRING'), 'a')} FROM ({side('source')} UNION ALL {side('target')})))")
        rows, path, who = f"lk{six}", lambda field, block=block: link(block, field), "CASE WHEN nth = 0 THEN id END"
        out += [_rows(rows, f"{n}{six} IS NULL", f"'missing_{FIELD[n]}'", path(FIELD[n]), who, "NULL") for n in (("base", "prefix") if six else ("base", "prefix", "mask"))]
        out.append(_rows(rows, f"prefix{six} IS NOT NULL AND p IS NULL", "'invalid_prefix_length'", path("prefix_length"), who, f"prefix{six}"))
        if not six:
            out.append(_rows(rows, f"p IS NOT NULL AND bit_count({_v4('mask')}) <> p", "'subnet_mask_mismatch'", path("subnet_mask"), who, "mask"))
        out.append(_rows(rows, f"base{six} IS NOT NULL AND b IS NULL OR b IS NOT NULL AND p IS NOT NULL AND net IS NULL", "'invalid_network_address'", path("network_address"), who, f"base{six}"))
        rows, path = f"en{six}", f"concat('/links/', pos, '/{block}/', side, '_ip')"
        inside = "starts_with(net, concat(regexp_replace(a, '::[0-9a-f]*$', '::'), '/'))" if six else f"{_up(f'({_v4("a")})', 'p')} = ({_v4('b')})"
        out += [
            _rows(rows, "device_pos IS NOT NULL AND e IS NULL AND NOT l2", "'missing_link_ip'", path, who, "NULL"), _rows(rows, "device_pos IS NOT NULL AND e IS NOT NULL AND a IS NULL", "'invalid_link_ip'", path, who, "e"),
            _rows(rows, f"device_pos IS NOT NULL AND a IS NOT NULL AND net IS NOT NULL AND NOT ({inside})", "'link_ip_outside_network'", path, who, "e"), _rows(rows, "device_pos IS NOT NULL AND bad IS NOT NULL", "bad", path, who, "a", _severity("bad")),
        ]
        full = " AND ".join(f"{n}_k IS NOT NULL" for n in needed)
        fam = 6 if six else 4
        mine = f"SELECT k, id, {fam} AS fam, a AS ip, concat('/devices/', pos, '/{block}/ip_address') AS path, NULL::INT AS link_pos FROM dv{six} WHERE active AND {full} AND nth = 0 AND a IS NOT NULL"
        ends = f"SELECT k, device AS id, {fam} AS fam, a AS ip, {path} AS path, CASE WHEN nth = 0 THEN pos END AS link_pos FROM en{six} WHERE device_pos IS NOT NULL AND a IS NOT NULL"
        uses += [mine, ends]
        own.append(mine)
        used.append(f"SELECT * FROM ({ends}) WHERE link_pos IS NOT NULL")
        nets.append(f"SELECT k, pos, {fam} AS fam, net, b, p, id FROM lk{six} WHERE nth = 0 AND net IS NOT NULL")
    union = " UNION ALL ".join
    ctes += [f"uses AS MATERIALIZED ({union(uses)})", f"own AS ({union(own)})", f"used AS ({union(used)})", f"nets AS MATERIALIZED ({union(nets)})"]
    ctes.append("degree AS (SELECT k, id, count(*) AS n FROM (SELECT k, source AS id FROM good UNION ALL SELECT k, target FROM good) GROUP BY ALL)")
    # a switch routes if its own addresses lie in several networks; then its links meet only within one
    ctes.append(
        """meet AS MATERIALIZED (SELECT g.*, sid AS sw, CASE WHEN base IS NOT NULL THEN concat(base, '/', coalesce(prefix, 'null')) END AS w4, CASE WHEN base6 IS NOT NULL THEN concat(base6, '/', prefix6) END AS w6, CASE WHEN sid = g.source THEN source_ip ELSE target_ip END AS i4, CASE WHEN sid = g.source THEN source_ip6 ELSE target_ip6 END AS i6
 FROM good g LEFT JOIN (SELECT k AS sk, id AS sid FROM known WHERE l2) s ON sk = g.k AND sid IN (g.source, g.target)),
routes AS (SELECT k, sw FROM meet WHERE sw IS NOT NULL GROUP BY ALL HAVING count(DISTINCT CASE WHEN i4 IS NOT NULL THEN coalesce(w4, '') END) > 1 OR count(DISTINCT CASE WHEN i6 IS NOT NULL THEN coalesce(w6, '') END) > 1),
spots AS (SELECT m.*, r.sw IS NOT NULL AS routed, CASE WHEN m.sw IS NULL THEN concat('link ', pos) WHEN r.sw IS NULL THEN m.sw ELSE concat(m.sw, ' ', coalesce(w4, w6, concat('link ', pos))) END AS spot FROM meet m LEFT JOIN routes r ON r.k = m.k AND r.sw = m.sw),
seg AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY first_pos) AS no FROM (SELECT *, min(pos) OVER (PARTITION BY k, spot) AS first_pos FROM spots)),
hosts AS (SELECT k, no, count(DISTINCT id) AS hosts FROM (SELECT k, no, source AS id, source = sw AS isw, routed, source_ip AS i4, source_ip6 AS i6 FROM seg UNION ALL SELECT k, no, target, target = sw, routed, target_ip, target_ip6 FROM seg) WHERE NOT coalesce(isw, false) OR routed OR i4 IS NOT NULL OR i6 IS NOT NULL GROUP BY ALL),
placed AS (SELECT seg.k, seg.no, seg.first_pos, seg.id AS link_id, nets.* EXCLUDE (k, id) FROM seg JOIN nets ON nets.k = seg.k AND nets.pos = seg.pos),
one AS (SELECT k, no, fam, min(net) AS net, min(b) AS b, min(p) AS p, min(first_pos) AS first_pos, min(pos) AS net_pos, arg_min(link_id, pos) AS net_link, count(DISTINCT net) AS n FROM placed GROUP BY k, no, fam)"""
    )
    block = "CASE fam WHEN 4 THEN 'network' ELSE 'network6' END"
    out += [
        _rows("known ANTI JOIN degree ON degree.k = known.k AND degree.id = known.id", "true", "'isolated_device'", at(), "id", "NULL"),
        "SELECT known.k, 'too_many_links', 'error', concat('/devices/', known.pos), known.id, NULL FROM known JOIN degree ON degree.k = known.k AND degree.id = known.id WHERE n > 1 AND lower(type) = 'pc'",
        "SELECT own.k, 'device_ip_not_on_link', 'error', own.path, own.id, own.ip FROM own SEMI JOIN used ON used.k = own.k AND used.id = own.id AND used.fam = own.fam ANTI JOIN used ON used.k = own.k AND used.id = own.id AND used.fam = own.fam AND used.ip = own.ip",
        "SELECT uses.k, 'duplicate_ip', 'error', path, id, ip FROM uses JOIN (SELECT k, fam, ip FROM uses GROUP BY ALL HAVING count(DISTINCT id) > 1) u USING (k, fam, ip)",
        "SELECT known.k, 'layer2_device_routes', 'warning', concat('/devices/', pos), id, NULL FROM known JOIN routes ON routes.k = known.k AND routes.sw = known.id",
        f"SELECT placed.k, 'segment_network_mismatch', 'error', concat('/links/', placed.pos, '/', {block}, '/network_address'), link_id, placed.net FROM placed JOIN one USING (k, no, fam) WHERE n > 1",
        f"SELECT one.k, 'network_too_small', 'error', concat('/links/', one.first_pos, '/', {block}, '/prefix_length'), seg.id, one.p::VARCHAR FROM one JOIN hosts USING (k, no) JOIN seg ON seg.k = one.k AND seg.pos = one.first_pos WHERE one.n = 1 AND fam = 4 AND CASE one.p WHEN 32 THEN 1 WHEN 31 THEN 2 ELSE (1::BIGINT << (32 - one.p)) - 2 END < hosts",
        f"SELECT a.k, 'overlapping_networks', 'error', concat('/links/', a.net_pos, '/', CASE a.fam WHEN 4 THEN 'network' ELSE 'network6' END, '/network_address'), a.net_link, a.net FROM one a JOIN one b ON a.k = b.k AND a.fam = b.fam AND a.no <> b.no AND a.n = 1 AND b.n = 1 WHERE CASE a.fam WHEN 6 THEN a.b = b.b ELSE {_up('(' + _v4('a.b') + ')', 'least(a.p, b.p)')} = {_up('(' + _v4('b.b') + ')', 'least(a.p, b.p)')} END",
        "SELECT u.k, 'ip_reused_on_several_links', 'error', concat('/devices/', known.pos), u.id, u.ip FROM (SELECT used.k, used.id, used.ip FROM used JOIN seg ON seg.k = used.k AND seg.pos = used.link_pos GROUP BY ALL HAVING count(DISTINCT seg.no) > 1) u JOIN known ON known.k = u.k AND known.id = u.id",
    ]
    found = "\nUNION ALL ".join(out)
    return "WITH " + ",\n".join(ctes) + f",\nfound(arch_id, code, severity, path, subject, value) AS (\n{found})\n"


VALIDATION = _validation_sql()
VALIDATION_SQL = VALIDATION + "SELECT * FROM found"
SUMMARY_SQL = (
    VALIDATION
    + """, n AS (SELECT arch_id, code, severity, count(*) AS n FROM found GROUP BY ALL)
SELECT k AS arch_id, coalesce(count(*) FILTER (severity = 'error'), 0) = 0 AS valid, coalesce(sum(n) FILTER (severity = 'error'), 0)::BIGINT AS errors, coalesce(sum(n) FILTER (severity = 'warning'), 0)::BIGINT AS warnings,
 coalesce(string_agg(concat(code, '=', n), ',' ORDER BY code, n) FILTER (code IS NOT NULL), '') AS codes FROM (SELECT DISTINCT k FROM d) a LEFT JOIN n ON n.arch_id = a.k GROUP BY k"""
)


def _readiness_sql() -> str:
    at = lambda *steps: "concat('/devices/', pos" + "".join(f", '/{s}'" for s in steps) + ")"
    link = lambda *steps: "concat('/links/', pos" + "".join(f", '/{s}'" for s in steps) + ")"
    row = lambda source, cond, code, path: f"SELECT k, '{code}', {path} FROM {source} WHERE {cond}"
    text = lambda n: f"CASE WHEN {n}_k = 'STRING' THEN {_v4(f'{n}_t')} END"
    full = " AND ".join(f"{n}_k IS NOT NULL" for n in DEVICE4)
    mask = "CASE WHEN p IS NOT NULL THEN 4294967296 - (1::BIGINT << (32 - p)) END"
    ctes = [
        TABLES.strip(),
        f"dv AS MATERIALIZED (SELECT *, active AND {full} AS whole, {text('ip')} AS i, {text('base')} AS b, {text('mask')} AS m FROM ({_device_fields('')}))",
        f"lk AS MATERIALIZED (SELECT * EXCLUDE (b), CASE WHEN whole AND {_up('b', 'p')} = b THEN b END AS net FROM (SELECT * EXCLUDE (p), CASE WHEN prefix::INT BETWEEN 0 AND 32 THEN prefix::INT END AS p, {_v4('base')} AS b, {_v4('mask')} AS m, base IS NOT NULL AND prefix IS NOT NULL AND mask IS NOT NULL AS whole FROM l WHERE is_object AND has_net))",
        f"en AS MATERIALIZED (SELECT x.*, known.pos AS device_pos, known.l2, known.id AS device, {_v4('e')} AS i FROM (SELECT *, 'source' AS side, source AS ref, source_ip AS e FROM lk UNION ALL SELECT *, 'target', target, target_ip FROM lk) x LEFT JOIN known ON known.k = x.k AND known.id = x.ref)",
        "main AS (SELECT k, id, pos, i FROM dv WHERE nth = 0 AND whole0 AND p IS NOT NULL AND i IS NOT NULL)".replace("whole0", f"({full})"),
        "degree AS (SELECT k, id, count(*) AS n FROM (SELECT k, source AS id FROM good UNION ALL SELECT k, target FROM good) GROUP BY ALL)",
    ]
    out = [
        row("d", "NOT is_object", "invalid_device", at()), row("d", f"is_object AND NOT {NAMED('id')}", "missing_device_id", at("id")), row("d", "nth > 0", "duplicate_device_id", at("id")), row("d", f"is_object AND NOT {NAMED('name')}", "missing_device_name", at("name")),
        row("d", f"is_object AND NOT {NAMED('type')}", "missing_device_type", at("type")), row("d", "is_object AND NOT has_net", "missing_device_network", at("network")),
        *[row("dv", f"active AND {n}_k IS NULL", f"missing_{FIELD[n]}", at("network", FIELD[n])) for n in DEVICE4],
        row("dv", "whole AND i IS NULL", "invalid_ip_address", at("network", "ip_address")), row("dv", "whole AND p IS NULL", "invalid_prefix_length", at("network", "prefix_length")), row("dv", "whole AND m IS NULL", "invalid_subnet_mask", at("network", "subnet_mask")),
        row("dv", f"whole AND m <> {mask}", "subnet_mask_mismatch", at("network", "subnet_mask")), row("dv", "whole AND b IS NULL", "invalid_network_address", at("network", "network_address")), row("dv", f"whole AND b <> {_up('i', 'p')}", "network_address_mismatch", at("network", "network_address")),
        row("l", "NOT is_object", "invalid_link", link()), row("l", f"is_object AND NOT {NAMED('id')}", "missing_link_id", link("id")), row("l", "nth > 0", "duplicate_link_id", link("id")), row("l", "is_object AND NOT has_net", "missing_link_network", link("network")),
        *[row("lk", f"{n} IS NULL", f"missing_{FIELD[n]}", link("network", FIELD[n])) for n in ("base", "prefix", "mask")], row("lk", "whole AND p IS NULL", "invalid_prefix_length", link("network", "prefix_length")),
        row("lk", f"whole AND m <> {mask}", "subnet_mask_mismatch", link("network", "subnet_mask")), row("lk", "whole AND p IS NOT NULL AND net IS NULL", "invalid_network_address", link("network", "network_address")),
        *[row(f"l ANTI JOIN known ON known.k = l.k AND known.id = l.{s}", "is_object", "unknown_device", link(s)) for s in ("source", "target")], row("l SEMI JOIN known ON known.k = l.k AND known.id = l.target", "is_object AND source = target", "self_link", link()),
        row("en", "device IS NOT NULL AND e IS NULL AND NOT l2", "missing_link_ip", "concat('/links/', pos, '/network/', side, '_ip')"), row("en", "device IS NOT NULL AND e IS NOT NULL AND i IS NULL", "invalid_link_ip", "concat('/links/', pos, '/network/', side, '_ip')"),
        row("en", f"device IS NOT NULL AND i IS NOT NULL AND net IS NOT NULL AND {_up('i', 'p')} <> net", "link_ip_outside_network", "concat('/links/', pos, '/network/', side, '_ip')"),
        row("known ANTI JOIN degree ON degree.k = known.k AND degree.id = known.id", "true", "isolated_device", at()), "SELECT known.k, 'too_many_links', concat('/devices/', known.pos) FROM known JOIN degree ON degree.k = known.k AND degree.id = known.id WHERE n > 1 AND lower(type) = 'pc'",
        "SELECT main.k, 'device_ip_not_on_link', concat('/devices/', main.pos, '/network/ip_address') FROM main SEMI JOIN en ON en.k = main.k AND en.device = main.id AND en.i IS NOT NULL ANTI JOIN en ON en.k = main.k AND en.device = main.id AND en.i = main.i",
    ]
    return "WITH " + ",\n".join(ctes) + ",\nfound(arch_id, code, path) AS (\n" + "\nUNION ALL ".join(out) + ")\nSELECT * FROM found"


READINESS_SQL = _readiness_sql()



def addressless_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where IPv4 is not required: devices, other than switches, that have a whole block of neither family."""
    devices, _ = tables(spark, sf_dir)
    found = validation._device_shape(devices, require_ipv4=False)
    return found.where("code = 'missing_device_address'").select("arch_id", "code", "path", "subject")


_WHOLE = lambda six, names: f"has_net{six} AND " + " AND ".join(f"{n}{six}_kind IS NOT NULL" for n in names)
ADDRESSLESS_SQL = f"""WITH {TABLES.strip()}
SELECT k AS arch_id, 'missing_device_address' AS code, concat('/devices/', pos) AS path, who AS subject FROM d
WHERE is_object AND NOT l2 AND NOT coalesce({_WHOLE("", DEVICE4)}, false) AND NOT coalesce({_WHOLE("6", ("ip", "prefix", "base"))}, false)"""

CATALOGUE: dict[str, tuple] = {
    "addressless_devices": (addressless_devices, ADDRESSLESS_SQL),
    "validation_findings": (validation_findings, VALIDATION_SQL),
    "validation_summary": (validation_summary, SUMMARY_SQL),
    "planted_readiness": (planted_readiness, READINESS_SQL),
}
