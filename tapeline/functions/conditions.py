"""JSON conditions compiled to columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeline.expr import EPS

# Spellings of the comparison operators.
_OPERATORS = {">=": ">=", "gte": ">=", ">": ">", "gt": ">", "<=": "<=", "lte": "<=", "<": "<", "lt": "<", "==": "=", "=": "=", "eq": "=", "!=": "<>", "ne": "<>"}


def compile_condition(payload: str, columns: list[str]) -> tuple[Column, str]:
    """(boolean column, status) of {"column"|"field", "operator", "value"}; the column is null unless evaluated.

    Statuses, the first that holds: unsupported_condition, missing_feature, unsupported_operator, non_numeric_value,
    evaluated. Equality is within a small tolerance.
    """
    null = F.lit(None).cast("boolean")
    body = json.loads(payload)
    name = body.get("column", body.get("field")) if isinstance(body, dict) else None
    if not isinstance(name, str) or "operator" not in body:
        return null, "unsupported_condition"
    if name not in columns:
        return null, "missing_feature"
    sign, value = _OPERATORS.get(body["operator"]), body.get("value")
    if sign is None:
        return null, "unsupported_operator"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return null, "non_numeric_value"
    c, v = F.col(name).cast("double"), float(value)
    near = F.abs(c - v) <= EPS
    return {">=": c >= v, ">": c > v, "<=": c <= v, "<": c < v, "=": near, "<>": ~near}[sign], "evaluated"
