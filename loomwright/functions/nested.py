"""Nested values of unknown shape (Variants): merging of settings and redaction of logged values.

Neither has a fixed schema or depth, so a short helper walks each value; rows come to it in Arrow batches as JSON.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Parts of a key that mark its value as secret, what stands for it, and how deep values are looked into.
SENSITIVE = ("key", "secret", "token", "password", "auth", "credential", "retellapikey", "vapiapikey", "service_role")
MASK, DEPTH = "[REDACTED]", 5


def merge(target: Any, source: Any) -> Any:
    """source over target: objects key by key, everything else (arrays and nulls too) replaces; what source does not name stays."""
    if not isinstance(target, dict) or not isinstance(source, dict):
        return source
    return target | {k: merge(target[k], v) if k in target else v for k, v in source.items()}


def redact(value: Any, depth: int = 0) -> Any:
    """value with secrets masked by key; objects and lists deeper than DEPTH stay as they are."""
    if depth > DEPTH:
        return value
    if isinstance(value, list):
        return [redact(v, depth + 1) for v in value]
    if isinstance(value, dict):
        return {k: MASK if any(s in k.lower() for s in SENSITIVE) else redact(v, depth + 1) for k, v in value.items()}
    return value


@F.pandas_udf(StringType())
def _merged(target: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([t if s is None or json.loads(s) is None else json.dumps(merge(json.loads(t) if t is not None else {}, json.loads(s))) for t, s in zip(target, source, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _redacted(value: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else json.dumps(redact(json.loads(v))) for v in value], dtype=object)


def merged(target: Column, source: Column) -> Column:
    """Two Variants as one; a missing or null source leaves the target, a missing target counts as empty."""
    return F.parse_json(_merged(F.to_json(target), F.to_json(source)))


def redacted(value: Column) -> Column:
    """A Variant whose secrets are masked; null stays null."""
    return F.parse_json(_redacted(F.to_json(value)))
