"""Metadata predicates: a JSON filter dialect, a small WHERE language and clause objects, compiled to Columns.

Metadata is JSON text (or VARIANT). Comparison is type-strict: 1, 1.0 and "1" differ under equality,
while order comparisons take any two numbers. Predicates are two-valued: a missing field is false
except for $ne, $nin and {$exists: false}; an explicit null is present.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 64
OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$contains")
_ORDER = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def validate(filt: dict, depth: int = 0) -> None:
    """Raises ValueError on an unknown operator or too deep a nesting."""
    if depth > MAX_DEPTH:
        raise ValueError(f"filter is nested more than {MAX_DEPTH} deep")
    for key, value in filt.items():
        if key in ("$and", "$or"):
            for part in value if isinstance(value, (list, tuple)) else ():
                if isinstance(part, dict):
                    validate(part, depth + 1)
        elif key.startswith("$"):
            raise ValueError(f"unknown top-level filter operator {key!r}")
        elif isinstance(value, dict):
            for op in value:
                if op not in OPERATORS:
                    raise ValueError(f"unknown filter operator {op!r} on field {key!r}")


class Field:
    """A path into a VARIANT column and the typed views that predicates need."""

    def __init__(self, variant: Column, path: str):
        keys = "".join("[" + json.dumps(k, ensure_ascii=False).replace("\\\"", "\\\"") + "]" for k in path.split("."))
        self.value = F.try_variant_get(variant, "$" + keys, "variant")
        self.kind = F.schema_of_variant(self.value)

    @property
    def missing(self) -> Column:
        return self.value.isNull()

    def _as(self, kind: str) -> Column:
        return F.try_variant_get(self.value, "$", kind)

    @property
    def is_int(self) -> Column:
        return self.kind == "BIGINT"

    @property
    def is_float(self) -> Column:
        return (self.kind == "DOUBLE") | (self.kind == "FLOAT") | self.kind.startswith("DECIMAL")

    @property
    def is_text(self) -> Column:
        return self.kind == "STRING"

    def equals(self, other: Any) -> Column:
        if other is None:
            test = F.is_variant_null(self.value)
        elif isinstance(other, bool):
            test = (self.kind == "BOOLEAN") & (self._as("boolean") == other)
        elif isinstance(other, int):
            test = self.is_int & (self._as("bigint") == F.lit(other)) if -(1 << 63) <= other < 1 << 63 else self.is_float & (self._as("double") == float(other))
        elif isinstance(other, float):
            test = self.is_float & (self._as("double") == other)
        elif isinstance(other, str):
            test = self.is_text & (self._as("string") == other)
        else:
            # Both sides pass through VARIANT, whose JSON text is canonical: keys sorted, no spaces.
            same = F.to_json(F.try_parse_json(F.lit(json.dumps(other))))
            test = (self.kind.startswith("OBJECT") | self.kind.startswith("ARRAY")) & (F.to_json(self.value) == same)
        return F.coalesce(test, F.lit(False))

    def compare(self, op: str, other: Any) -> Column:
        if isinstance(other, str):
            test = self.is_text & getattr(self._as("string"), _ORDER[op])(other)
        elif isinstance(other, (int, float)) and not isinstance(other, bool):
            test = (self.is_int | self.is_float) & getattr(self._as("double"), _ORDER[op])(float(other))
        else:
            return F.lit(False)
        return F.coalesce(test, F.lit(False))

    def apply(self, op: str, other: Any) -> Column:
        if op == "$eq":
            return self.equals(other)
        if op == "$ne":
            return ~self.equals(other)
        if op in _ORDER:
            return self.compare(op, other)
        if op in ("$in", "$nin"):
            if not isinstance(other, (list, tuple)):
                return F.lit(False)
            test = F.lit(False)
            for x in other:
                test = test | self.equals(x)
            return test if op == "$in" else ~test
        if op == "$exists":
            return (~self.missing if other else self.missing) if isinstance(other, bool) else F.lit(False)
        if op == "$contains":
            return F.coalesce(self.is_text & self._as("string").contains(other), F.lit(False)) if isinstance(other, str) else F.lit(False)
        raise ValueError(f"unknown filter operator {op!r}")


def variant(metadata: Column | str, is_json: bool = True) -> Column:
    c = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.coalesce(F.try_parse_json(c) if is_json else c, F.parse_json(F.lit("{}")))


def compile_filter(filt: dict | None, metadata: Column | str = "metadata", is_json: bool = True, promoted: dict[str, str] | None = None) -> Column:
    """A two-valued predicate. ``promoted`` maps fields that are columns of their own to them, so that they reach the scan."""
    if not filt:
        return F.lit(True)
    validate(filt)
    v = variant(metadata, is_json)

    def build(f: dict) -> Column:
        test = F.lit(True)
        for key, value in f.items():
            if key in ("$and", "$or"):
                if not isinstance(value, (list, tuple)):
                    test = test & F.lit(False)
                    continue
                parts = [build(p) if isinstance(p, dict) else F.lit(False) for p in value]
                joined = F.lit(key == "$and")
                for p in parts:
                    joined = joined & p if key == "$and" else joined | p
                test = test & joined
            elif promoted and key in promoted:
                test = test & _plain(F.col(promoted[key]), value)
            elif isinstance(value, dict):
                field = Field(v, key)
                for op, other in value.items():
                    test = test & field.apply(op, other)
            else:
                test = test & Field(v, key).equals(value)
        return test

    return build(filt)


def matching(df: DataFrame, filt: dict | None, metadata: str = "metadata", promoted: dict[str, str] | None = None) -> DataFrame:
    """The rows of df that fulfil a filter. Each object is parsed once, however many fields the filter has: the parsed value
    comes out of a generator, which the optimiser doesn't repeat."""
    if not filt:
        return df
    name = "parsed"
    while name in df.columns:
        name += "_"
    parsed = df.select(*df.columns, F.explode(F.array(variant(metadata))).alias(name))
    return parsed.where(compile_filter(filt, name, is_json=False, promoted=promoted)).drop(name)


def _plain(c: Column, value: Any) -> Column:
    test = F.lit(True)
    for op, other in (value if isinstance(value, dict) else {"$eq": value}).items():
        if op in ("$eq", "$ne"):
            one = c.isNull() if other is None else F.coalesce(c == other, F.lit(False))
            one = one if op == "$eq" else ~one
        elif op in ("$in", "$nin"):
            one = F.coalesce(c.isin(list(other)), F.lit(False))
            one = one if op == "$in" else ~one
        elif op == "$exists":
            one = c.isNotNull() if other else c.isNull()
        elif op == "$contains":
            one = F.coalesce(c.contains(other), F.lit(False))
        else:
            one = F.coalesce(getattr(c, _ORDER[op])(other), F.lit(False))
        test = test & one
    return test


def _look_up(meta: Any, path: str) -> tuple[bool, Any]:
    for part in path.split("."):
        if not isinstance(meta, dict) or part not in meta:
            return False, None
        meta = meta[part]
    return True, meta


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
        return type(a) is type(b) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return type(a) is type(b) and a == b
    if isinstance(a, list) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b


def matches(meta: dict, filt: dict) -> bool:
    """The same semantics on one Python value; the tests hold the compiler against it."""

    def leaf(present: bool, x: Any, op: str, other: Any) -> bool:
        if op == "$eq":
            return present and _same(x, other)
        if op == "$ne":
            return not (present and _same(x, other))
        if op in _ORDER:
            number = lambda y: isinstance(y, (int, float)) and not isinstance(y, bool)
            if not present or not (number(x) and number(other) or isinstance(x, str) and isinstance(other, str)):
                return False
            return bool(getattr(float(x), _ORDER[op])(float(other)) if number(x) else getattr(x, _ORDER[op])(other))
        if op == "$in":
            return isinstance(other, (list, tuple)) and present and any(_same(x, y) for y in other)
        if op == "$nin":
            return isinstance(other, (list, tuple)) and not (present and any(_same(x, y) for y in other))
        if op == "$exists":
            return isinstance(other, bool) and present == other
        return op == "$contains" and present and isinstance(x, str) and isinstance(other, str) and other in x

    for key, value in filt.items():
        if key in ("$and", "$or"):
            parts = [isinstance(p, dict) and matches(meta, p) for p in value] if isinstance(value, (list, tuple)) else [False] if key == "$and" else []
            if not (all(parts) if key == "$and" else any(parts)):
                return False
            continue
        present, x = _look_up(meta, key)
        for op, other in (value.items() if isinstance(value, dict) else [("$eq", value)]):
            if not leaf(present, x, op, other):
                return False
    return True


_NUMBER = r"-?\d+(?:\.\d+)?"


def parse_where(where: str) -> dict:
    """``f IN (...)``, ``f = 'v'``, ``f != 'v'``, ``f = n`` and ``f < <= > >= n`` to the JSON dialect; else NotImplementedError.

    A number stands for the integer and the float of its value.
    """
    if m := re.fullmatch(r"\s*(\w+)\s+in\s*\(([^)]+)\)\s*", where, re.I):
        parts = [p.strip() for p in m[2].split(",")]
        if not all(parts):
            raise ValueError(f"empty value in {where!r}")
        return {m[1]: {"$in": [p.strip("'\"") for p in parts]}}
    if m := re.fullmatch(r"\s*(\w+)\s*(!?=)\s*'([^']*)'\s*", where):
        return {m[1]: {"$eq" if m[2] == "=" else "$ne": m[3]}}
    if m := re.fullmatch(rf"\s*(\w+)\s*=\s*({_NUMBER})\s*", where):
        x = float(m[2])
        return {m[1]: {"$in": [int(x), x]}} if math.isfinite(x) and x == int(x) else {m[1]: {"$eq": x}}
    if m := re.fullmatch(rf"\s*(\w+)\s*(>=|<=|>|<)\s*({_NUMBER})\s*", where):
        return {m[1]: {{">": "$gt", ">=": "$gte", "<": "$lt", "<=": "$lte"}[m[2]]: float(m[3])}}
    raise NotImplementedError(f"unsupported WHERE clause: {where!r}")


_CLAUSES = {"==": "$eq", "!=": "$ne", ">": "$gt", ">=": "$gte", "<": "$lt", "<=": "$lte", "in": "$in", "nin": "$nin", "not in": "$nin", "contains": "$contains"}


def from_clauses(filters: Any) -> dict | None:
    """Clause objects (``key``, ``operator``, ``value``; groups have ``filters`` and ``condition``) to the JSON dialect."""
    if filters is None:
        return None
    children = getattr(filters, "filters", None)
    if children is None:
        op = getattr(filters, "operator", None)
        op = "==" if op is None else str(getattr(op, "value", op))
        key = getattr(filters, "key", None) or getattr(filters, "field", None)
        if op not in _CLAUSES:
            raise ValueError(f"unsupported operator {op!r}; one of {sorted(_CLAUSES)}")
        if not key:
            raise ValueError("a clause needs a key")
        return {key: {_CLAUSES[op]: getattr(filters, "value", None)}}
    parts = [p for p in map(from_clauses, children) if p]
    if len(parts) < 2:
        return parts[0] if parts else None
    condition = getattr(filters, "condition", None) or "and"
    return {"$or" if str(getattr(condition, "value", condition)).lower() == "or" else "$and": parts}


def from_dict(filt: Any) -> dict | None:
    """Passes dicts of the dialect through; anything else is an error."""
    if filt is None or isinstance(filt, dict):
        return filt
    raise ValueError(f"unsupported filter type {type(filt).__name__}")


def facet(df: DataFrame, path: str, metadata: str = "metadata") -> DataFrame:
    """(value, count) of a field; missing ones are left out. Each object is parsed once: the field comes out of a generator."""
    v = df.select(F.col(metadata).alias("m"), F.explode(F.array(variant(metadata))).alias("v"))
    f = v.select("m", F.explode(F.array(Field(F.col("v"), path).value)).alias("f")).where("f is not null")
    return f.select(_shown(F.col("f"), F.col("m"), path).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count"))


def _shown(value: Column, text: Column, path: str) -> Column:
    """A field's value as facets show it; ``text`` is the JSON text that it comes from."""
    kind = F.schema_of_variant(value)
    raw = F.get_json_object(text, "$" + "".join(f"['{k}']" for k in path.split(".")))
    whole = (kind == "BIGINT") | (kind == "BOOLEAN") | (kind == "STRING")
    # The original text keeps 1.0 apart from 1, which VARIANT's rendering may not.
    return F.when(whole, F.try_variant_get(value, "$", "string")).when(F.is_variant_null(value), F.lit("null")).when((kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL"), raw).otherwise(F.to_json(value))


def field_text(metadata: Column | str, path: str, is_json: bool = True) -> Column:
    """A field as facets show it: strings bare, all else as JSON text; null where missing, "null" for an explicit null."""
    f = Field(variant(metadata, is_json), path)
    raw = F.get_json_object(F.col(metadata) if isinstance(metadata, str) else metadata, "$" + "".join(f"['{k}']" for k in path.split("."))) if is_json else F.to_json(f.value)
    # The original text keeps 1.0 apart from 1, which VARIANT's rendering may not.
    return F.when(f.missing, F.lit(None)).when(F.is_variant_null(f.value), F.lit("null")).when(f.is_text, f._as("string")).when(f.is_float, raw).otherwise(F.to_json(f.value))
