"""Text functions: Python-like quoting, tokens, fields, JSON pointers and the label classifier."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import addr, ipv6

NAME = r"\A[A-Za-z]{1,12}[-_]?[0-9]{1,4}\Z"
# Link and interface words that are never device names.
LINK_WORDS = (
    "gigabitethernet tengigabitethernet hundredgigabitethernet fastethernet tengige hundredgige gigabit ethernet fiber copper optical serial loopback "
    "tunnel vlan port-?channel management mgmt trunk uplink downlink duplex eth gi ge gig fa fe te hu se lo tu po vl"
).split()
LINK_TYPE = rf"(?i)\A(?:{'|'.join(LINK_WORDS)})[-_]?[0-9]{{0,4}}(?:/[0-9]{{1,4}}){{0,3}}(?:\.[0-9]{{1,4}})?\Z"
LABEL = r"\A([A-Za-z][A-Za-z0-9 _-]{0,20}):\s*(.+)\Z"
# Labels with digits that only introduce an address.
ADDRESS_LABELS = ("ipv4", "ipv6", "ip4", "ip6", "inet", "inet4", "inet6")
ADDRESSES = ("ipv4", "ipv4_cidr", "subnet_mask", "ipv6", "ipv6_cidr")
#: Confidence in a class, and factors of the three repairs.
CONFIDENCE = {"ipv4": 1.0, "ipv4_cidr": 1.0, "subnet_mask": 1.0, "ipv6": 1.0, "ipv6_cidr": 1.0, "host_suffix": 0.95, "device_name": 0.90}
REPAIRED, SPLIT, STRIPPED = 0.90, 0.90, 0.85


def named(c: Column) -> Column:
    """A string with something other than white space (Unicode's) in it."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def quoted(c: Column) -> Column:
    """A string in quotes, as Python shows it, for printable text."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    plain = ~c.contains("'") | c.contains('"')
    return F.when(plain, F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def card_field(c: Column, name: str) -> Column:
    """The value of a line ``Name: value``; empty if there is none."""
    return F.regexp_extract(c, rf"(?m)^{name}: (.+)$", 1)


def pointer(c: Column) -> Column:
    """A key as a step of a JSON pointer."""
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


@F.pandas_udf(StringType())
def normalize(text: pd.Series) -> pd.Series:
    """NFKC, with white space collapsed and trimmed; Spark has no NFKC of its own."""
    return text.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()), na_action="ignore")


def is_link_type(c: Column) -> Column:
    return c.rlike(LINK_TYPE)


def classify(c: Column, canonical6: Column | None = None, name_pattern: str = NAME, link_pattern: str = LINK_TYPE) -> Column:
    """Class of one normalised token, by the first that fits.

    ``canonical6``: the canonical form of the part before any slash, if that is an IPv6
    address; computed with ``functions.ipv6.canonical`` unless given.
    """
    canonical6 = ipv6.canonical(F.split_part(c, F.lit("/"), F.lit(1))) if canonical6 is None else canonical6
    prefix6 = F.regexp_extract(c, r"\A[^/]+/(0|[1-9][0-9]{0,2})\z", 1).try_cast("int")
    return (
        F.when(addr.is_cidr(c), "ipv4_cidr")
        .when(c == "0.0.0.0", "unknown")
        .when(addr.mask_to_prefix(c).isNotNull(), "subnet_mask")
        .when(addr.is_ipv4(c), "ipv4")
        .when(addr.host_suffix(c).isNotNull() | addr.host_suffix6(c).isNotNull(), "host_suffix")
        .when(canonical6.isNotNull() & (prefix6 <= 128), "ipv6_cidr")
        .when(canonical6.isNotNull() & ~c.contains("/"), "ipv6")
        .when(c.rlike(link_pattern), "unknown")
        .when(c.rlike(name_pattern), "device_name")
        .otherwise("unknown")
    )


def confidence(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.when(kind.isin(*CONFIDENCE), kind))
