"""Writers, canonical JSON and revisions."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.findings import in_order


def _no_repeats(pairs):
    keys = [k for k, _ in pairs]
    if len(set(keys)) != len(keys):
        raise ValueError("repeated key")
    return dict(pairs)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("not finite")
    return value


def strict_loads(text: str):
    """JSON without repeated keys, NaN, Infinity or numbers that overflow."""

    def refuse(name):
        raise ValueError(name)

    return json.loads(text, object_pairs_hook=_no_repeats, parse_float=_finite, parse_constant=refuse)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The same document with sorted keys and no spare blanks; NULL for what is not strict JSON."""

    def one(t):
        try:
            return json.dumps(strict_loads(t), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        except (ValueError, TypeError, RecursionError):
            return None

    return text.map(one, na_action="ignore")


@F.pandas_udf(StructType([StructField("code", StringType()), StructField("path", StringType())]))
def json_problem(text: pd.Series) -> pd.DataFrame:
    """The first strictness problem of a text: json_nesting_limit (over 64 levels) or invalid_json_value."""

    def depth(v, path=""):
        stack = [(v, 0, "")]
        while stack:
            item, level, at = stack.pop()
            if level > 64:
                return at
            if isinstance(item, dict):
                stack += [(c, level + 1, f"{at}/{k.replace('~', '~0').replace('/', '~1')}") for k, c in item.items()]
            elif isinstance(item, list):
                stack += [(c, level + 1, f"{at}/{i}") for i, c in enumerate(item)]
        return None

    def one(t):
        try:
            at = depth(strict_loads(t))
        except RecursionError:
            return "json_nesting_limit", ""
        except (ValueError, TypeError):
            return "invalid_json_value", ""
        return (None, None) if at is None else ("json_nesting_limit", at)

    return pd.DataFrame([one(t) for t in text], columns=["code", "path"])


def revision(raw: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical_json(raw), 256)


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings in document order, as one Parquet table; the commit protocol makes it appear whole or not at all."""
    in_order(findings).sortWithinPartitions("arch_id", "rule_ord").write.mode("overwrite").parquet(path)


def write_documents(rows: DataFrame, path: str, column: str = "doc") -> None:
    """One line of JSON for each row's struct."""
    rows.select(F.to_json(column).alias("value")).write.mode("overwrite").text(path)


def keep_first(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What is stored, and of the new rows those whose key is not: a first version is never overwritten."""
    return stored.unionByName(new.join(stored.select(key), key, "left_anti"))
