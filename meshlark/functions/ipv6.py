"""IPv6 address algebra on Columns.  An address is a struct of four BIGINT limbs of 32 bits.

Built-in expressions only, so nothing leaves the JVM; limbs leave room for carries, so
sums of addresses are sums of limbs, windows included.  What is not an address gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import addr
from .addr import bind

LIMB = 1 << 32
LIMBS = ("a", "b", "c", "d")
_GROUP = "^[0-9a-f]{1,4}$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def limbs(values: list[Column]) -> Column:
    return F.struct(*[v.cast("bigint").alias(n) for v, n in zip(values, LIMBS, strict=True)])


def literal(value: int) -> Column:
    """A number of 128 bits."""
    return limbs([F.lit(value >> s & (LIMB - 1)) for s in (96, 64, 32, 0)])


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("bigint")


def parse(text) -> Column:
    """Limbs of an IPv6 address: eight groups of up to four hex digits, ``::`` for one zero group or more, or dotted IPv4 in the last two."""

    def whole(t: Column) -> Column:
        """The text with a dotted end as two groups."""
        tail = F.regexp_extract(t, r"([^:]*\.[^:]*)$", 1)
        four = addr.ip_to_int(tail)
        groups = F.concat_ws(":", F.lower(F.hex(F.shiftright(four, 16))), F.lower(F.hex(four.bitwiseAND(F.lit(0xFFFF)))))
        return F.when(~t.contains("."), t).when(four.isNotNull(), F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(tail)), groups))

    def split(t: Column) -> Column:
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))

    def groups(t: Column) -> Column:
        halves = F.split(t, "::")
        return F.when(
            F.size(halves) == 2, bind(F.struct(split(halves[0]).alias("l"), split(halves[1]).alias("r")), lambda h: F.when(F.size(h["l"]) + F.size(h["r"]) <= 7, F.concat(h["l"], F.array_repeat(F.lit("0"), (8 - F.size(h["l"]) - F.size(h["r"])).cast("int")), h["r"]))),
        ).when(F.size(halves) == 1, F.split(t, ":"))

    def numbers(g: Column) -> Column:
        two = lambda i: _number(F.get(g, F.lit(i))) * 65536 + _number(F.get(g, F.lit(i + 1)))
        return F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike(_GROUP)), limbs([two(i) for i in (0, 2, 4, 6)]))

    t = _col(text)
    lower = F.when(t.rlike(r"\A[0-9A-Fa-f:.]+\z") & t.contains(":"), F.lower(t))
    return bind(bind(bind(lower, whole), groups), numbers)


def hex32(a: Column) -> Column:
    """The address as 32 hex digits."""
    return bind(a, lambda x: F.concat(*[F.lower(F.lpad(F.hex(x[n]), 8, "0")) for n in LIMBS]))


def text_of(a: Column) -> Column:
    """Canonical text: lower case, no leading zeros, the first longest run of two zero groups or more as ``::``, mapped IPv4 dotted."""
    both = lambda v: [F.shiftright(v, 16), v.bitwiseAND(F.lit(0xFFFF))]

    def written(g: Column) -> Column:
        # zero groups as 0, others as 1: the first longest run is where the most zeros in a row are found first
        marks = F.concat_ws("", F.transform(g, lambda x: F.when(x == "0", "0").otherwise("1")))
        return bind(F.struct(g.alias("g"), bind(marks, run_of).alias("run")), short)

    def run_of(marks: Column) -> Column:
        return F.coalesce(*[F.when(marks.contains("0" * n), F.struct(F.instr(marks, "0" * n).alias("at"), F.lit(n).alias("n"))) for n in range(8, 1, -1)])

    def short(k: Column) -> Column:
        g, at, n = k["g"], k["run"]["at"], k["run"]["n"]
        left, right = F.slice(g, 1, at - 1), F.slice(g, at + n, F.greatest(8 - (at + n) + 1, F.lit(0)))
        return F.when(k["run"].isNull(), F.concat_ws(":", g)).otherwise(F.concat(F.concat_ws(":", left), F.lit("::"), F.concat_ws(":", right)))

    def of(x: Column) -> Column:
        groups = F.array(*[F.lower(F.hex(g)) for n in LIMBS for g in both(x[n])])
        return F.when(mapped(x), F.concat(F.lit("::ffff:"), addr.int_to_ip(x["d"]))).when(x.isNotNull(), bind(groups, written))

    return bind(a, of)


def mapped(a: Column) -> Column:
    """Whether an IPv4 address is written as IPv6."""
    return (a["a"] == 0) & (a["b"] == 0) & (a["c"] == 0xFFFF)


def mask(prefix: Column) -> Column:
    """Limbs of the mask of a prefix length 0..128."""
    kept = lambda i: F.least(F.greatest(prefix - 32 * i, F.lit(0)), F.lit(32)).cast("int")
    return limbs([F.lit(LIMB) - F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - kept(i)) for i in range(4)])


def _by_limb(x: Column, y: Column, how) -> Column:
    return limbs([how(x[n], y[n]) for n in LIMBS])


def network(a: Column, prefix: Column) -> Column:
    return F.when(prefix.between(0, 128) & a.isNotNull(), bind(F.struct(a.alias("x"), mask(prefix).alias("m")), lambda k: _by_limb(k["x"], k["m"], lambda x, m: x.bitwiseAND(m))))


def last(a: Column, prefix: Column) -> Column:
    """The highest address of the network that starts at ``a``."""
    return F.when(a.isNotNull(), bind(F.struct(a.alias("x"), mask(prefix).alias("m")), lambda k: _by_limb(k["x"], k["m"], lambda x, m: x.bitwiseOR(F.lit(LIMB - 1) - m))))


def size(prefix: Column) -> Column:
    """Limbs of 2 ** (128 - prefix) for prefixes 1..128, and of a fifth one, ``o``, that holds it for 0."""
    bit = 128 - prefix
    one = lambda i: F.when(bit.between(32 * i, 32 * i + 31), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit - 32 * i).cast("int"))).otherwise(F.lit(0))
    return F.struct(one(4).cast("bigint").alias("o"), *[one(i).cast("bigint").alias(n) for i, n in zip((3, 2, 1, 0), LIMBS, strict=True)])


def carried(a: Column) -> Column:
    """Limbs (o, a, b, c, d), each a sum of any size, brought below 2 ** 32 but for o."""
    low = lambda v: v.bitwiseAND(F.lit(LIMB - 1))
    high = lambda v: F.shiftright(v, 32)

    def step(names: list[str]):
        """Carries from the last of the names to the one before it."""

        def one(k: Column) -> Column:
            *_, to, frm = names
            return F.struct(*[(k[n] + high(k[frm]) if n == to else low(k[n]) if n == frm else k[n]).alias(n) for n in ("o", *LIMBS)])

        return one

    for names in (["c", "d"], ["b", "c"], ["a", "b"], ["o", "a"]):
        a = bind(a, step(names))
    return a


def widened(a: Column) -> Column:
    return bind(a, lambda x: F.struct(F.lit(0).cast("bigint").alias("o"), *[x[n].alias(n) for n in LIMBS]))


def plus(a: Column, b: Column) -> Column:
    """Sum of two addresses of limbs (o, a, b, c, d)."""
    return carried(bind(F.struct(a.alias("x"), b.alias("y")), lambda k: F.struct(*[(k["x"][n] + k["y"][n]).alias(n) for n in ("o", *LIMBS)])))


def narrowed(a: Column) -> Column:
    """Limbs (o, a, b, c, d) as an address; NULL beyond 128 bits."""
    return bind(a, lambda x: F.when((x["o"] == 0) & x["d"].isNotNull(), limbs([x[n] for n in LIMBS])))


def of_long(value: Column) -> Column:
    """A number of up to 63 bits as limbs (o, a, b, c, d)."""
    zero = F.lit(0).cast("bigint")
    return F.struct(zero.alias("o"), zero.alias("a"), zero.alias("b"), F.shiftright(value, 32).alias("c"), value.bitwiseAND(F.lit(LIMB - 1)).alias("d"))


def problem(a: Column, prefix: Column) -> Column:
    """struct(code, severity) of an address that cannot be a device's, else NULL."""
    said = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))

    def of(k: Column) -> Column:
        x, p = k["x"], k["p"]
        top = lambda n: F.shiftright(x["a"], n)
        reserved = x.isin(literal(0), literal(1)) | (top(24) == 0xFF) | (mapped(x) & (F.shiftright(x["d"], 24) == 127))
        zone = p.isNotNull() & (p <= 126) & (network(x, p) == x)
        return F.when(reserved, said("reserved_ip", "error")).when(zone, said("ip_is_network_address", "error")).when(top(22) == 0xFE80 >> 6, said("link_local_ip", "warning"))

    return bind(F.struct(a.alias("x"), prefix.alias("p")), of)


def device_facts(text, prefix) -> Column:
    """struct(canonical, base, code, severity) of an IPv6 address, parsed once: its text, its network's, and its host problem; fields are NULL for other text."""
    t, p = _col(text), _col(prefix)

    def of(k: Column) -> Column:
        return bind(problem(k["six"], k["p"]), lambda bad: F.struct(text_of(k["six"]).alias("canonical"), text_of(network(k["six"], k["p"])).alias("base"), bad["code"].alias("code"), bad["severity"].alias("severity")))

    return bind(F.struct(parse(t).alias("six"), p.cast("int").alias("p")), lambda k: F.when(k["six"].isNotNull(), of(k)))


def ip_facts(text, prefix) -> Column:
    """struct(version, canonical, packed, code, severity): 4 or 16 bytes; for IPv6 also the host problem with that prefix."""
    t, p = _col(text), _col(prefix)
    empty = F.lit(None)

    def of(k: Column) -> Column:
        six = k["six"]
        return F.when(
            six.isNotNull(),
            bind(problem(six, k["p"]), lambda bad: F.struct(F.lit(6).alias("version"), text_of(six).alias("canonical"), F.unhex(hex32(six)).alias("packed"), bad["code"].alias("code"), bad["severity"].alias("severity"))),
        ).otherwise(
            F.struct(
                F.when(k["four"].isNotNull(), 4).alias("version"), addr.int_to_ip(k["four"]).alias("canonical"), F.unhex(F.lpad(F.hex(k["four"]), 8, "0")).alias("packed"), empty.cast("string").alias("code"), empty.cast("string").alias("severity"),
            )
        )

    return bind(F.struct(parse(t).alias("six"), addr.ip_to_int(t).alias("four"), p.cast("int").alias("p")), of)


def network_of(text, prefix) -> Column:
    """Canonical base of either family; NULL for what is no address or prefix."""
    t, p = _col(text), _col(prefix)
    six = bind(F.struct(parse(t).alias("a"), p.cast("int").alias("p")), lambda k: text_of(network(k["a"], k["p"])))
    return F.when(t.contains(":"), six).otherwise(addr.int_to_ip(addr.network_of(addr.ip_to_int(t), p)))


def canonical(text) -> Column:
    """Compressed lower-case IPv6; NULL for zones, other characters and the unspecified address."""
    return bind(parse(text), lambda a: F.when(a != literal(0), text_of(a)))


def resolve_suffix(net, prefix, value) -> Column:
    """struct(address, reason): an IPv6 network and the number of its drawn ``::N`` suffix."""
    p, v = _col(prefix), _col(value)

    def of(k: Column) -> Column:
        a, q, n = k["a"], k["p"], k["v"]
        fits = (128 - q >= 63) | (n < F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(128 - q, F.lit(62))))
        reason = (
            F.when(a.isNull() | q.isNull() | ~q.between(0, 128), "invalid_network")
            .when(q >= 128, "prefix_has_no_host_bits")
            .when(network(a, q) != a, "network_address_has_host_bits")
            .when(n.isNull() | ~fits, "suffix_outside_network")
            .otherwise("resolved")
        )
        whole = text_of(narrowed(plus(widened(a), of_long(n))))  # no host bit is set, so a sum is a union
        return bind(F.struct(reason.alias("r"), whole.alias("w")), lambda x: F.struct(F.when(x["r"] == "resolved", x["w"]).alias("address"), x["r"].alias("reason")))

    return bind(F.struct(parse(net).alias("a"), p.cast("int").alias("p"), v.cast("bigint").alias("v")), of)


def network_range(base, prefix) -> Column:
    """struct(lo, hi, text): first and last address of a network as 32 hex digits, and its text; NULL if the base has host bits set."""
    t, p = _col(base), _col(prefix)
    no = lambda: F.struct(*[F.lit(None).cast("string").alias(n) for n in ("lo", "hi", "text")])
    slash = lambda text, q: F.concat(text, F.lit("/"), q.cast("string"))

    def six(k: Column) -> Column:
        a, q = k["a"], k["p"]
        return F.when(network(a, q) == a, F.struct(hex32(a).alias("lo"), hex32(last(a, q)).alias("hi"), slash(text_of(a), q).alias("text"))).otherwise(no())

    def four(k: Column) -> Column:
        a, q = k["a"], k["p"]
        wide = lambda v: F.lower(F.lpad(F.hex(v), 32, "0"))
        return F.when(addr.network_of(a, q) == a, F.struct(wide(a).alias("lo"), wide(addr.broadcast_of(a, q)).alias("hi"), slash(addr.int_to_ip(a), q).alias("text"))).otherwise(no())

    return F.when(t.contains(":"), bind(F.struct(parse(t).alias("a"), p.cast("int").alias("p")), six)).otherwise(bind(F.struct(addr.ip_to_int(t).alias("a"), p.cast("int").alias("p")), four))
