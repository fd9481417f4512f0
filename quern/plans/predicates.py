"""Predicate trees in JSON to Spark columns, and what can be read off a tree.

A node is ``{"type": KIND, "body": {...}}``. Binary kinds have ``leftExpr`` and ``rightExpr``; FIELD has ``column``
(``name`` or ``{"name", "type"}``); CONST has ``datum`` (``{"type", "val"}`` or a plain value). Semantics are those of
SQL: three-valued logic, numeric coercion in comparisons, full LIKE patterns.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type names by their first letters.
TYPES = (("TEXT", "string"), ("INT", "bigint"), ("LONG", "bigint"), ("FLOAT", "double"), ("DOUBLE", "double"), ("BOOL", "boolean"), ("DATE", "date"), ("BLOB", "binary"), ("NULL", "void"))


def sql_type(name: str) -> str:
    """The SQL type of a type name, which may have a suffix (INT8, FLOAT8)."""
    for prefix, kind in TYPES:
        if name.upper().startswith(prefix):
            return kind
    raise ValueError(f"unknown type {name!r}")


_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "AND": lambda a, b: a & b,
    "OR": lambda a, b: a | b,
    "EQUAL": lambda a, b: a == b,
    "NOT_EQUAL": lambda a, b: a != b,
    "LTH": lambda a, b: a < b,
    "LEQ": lambda a, b: a <= b,
    "GTH": lambda a, b: a > b,
    "GEQ": lambda a, b: a >= b,
    "LIKE": lambda a, b: a.like(b) if isinstance(b, str) else F.like(a, b),
    "PLUS": lambda a, b: a + b,
    "MINUS": lambda a, b: a - b,
    "MULTIPLY": lambda a, b: a * b,
    "DIVIDE": lambda a, b: a / b,
    "MODULAR": lambda a, b: a % b,
    "BIT_AND": lambda a, b: a.bitwiseAND(b),
    "BIT_OR": lambda a, b: a.bitwiseOR(b),
    "BIT_XOR": lambda a, b: a.bitwiseXOR(b),
    "REGEX": lambda a, b: F.rlike(a, b),
    "SIMILAR_TO": lambda a, b: F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
    "CONCATENATE": lambda a, b: F.concat(a, b),
}

_AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def field(name: str) -> Column:
    """A column by its name; a dotted name is one column (``db.table.col``) unless the caller aliases tables."""
    return F.col("`" + name.replace("`", "``") + "`")


def to_column(tree: str | dict, resolve: Callable[[str], Column] = field) -> Column:
    """The column that a tree stands for; ``resolve`` turns field names into columns."""
    node = json.loads(tree) if isinstance(tree, str) else tree
    kind, body = node["type"].upper(), node.get("body", {})

    def sub(key: str) -> Column:
        return to_column(body[key], resolve)

    if kind == "FIELD":
        c = body["column"]
        return resolve(c if isinstance(c, str) else c["name"])
    if kind == "CONST":
        return _constant(body["datum"])
    if kind == "ROW_CONSTANT":
        return F.array(*[_constant(v) for v in body["values"]])
    if kind == "NOT":
        return ~sub("expr")
    if kind == "IS_NULL":
        c = sub("leftExpr") if "leftExpr" in body else sub("expr")
        return c.isNotNull() if body.get("isNot") else c.isNull()
    if kind == "SIGNED":
        return -sub("expr") if body.get("negative", True) else sub("expr")
    if kind == "CAST":
        return sub("expr").try_cast(sql_type(body["target"]))
    if kind == "IN":
        right = body["rightExpr"]
        if right["type"].upper() == "ROW_CONSTANT":
            found = sub("leftExpr").isin(*[_value(v) for v in right["body"]["values"]])
        else:
            found = F.array_contains(sub("rightExpr"), sub("leftExpr"))
        return ~found if body.get("isNot") else found
    if kind == "BETWEEN":
        return sub("expr").between(sub("begin"), sub("end"))
    if kind == "CASE":
        out = None
        for w in body["when"]:
            pair = (to_column(w["condition"], resolve), to_column(w["result"], resolve))
            out = F.when(*pair) if out is None else out.when(*pair)
        return out.otherwise(to_column(body["else"], resolve)) if body.get("else") else out
    if kind == "IF_THEN":
        return F.when(sub("condition"), sub("result"))
    if kind == "FUNCTION":
        return F.call_function(body["name"], *[to_column(a, resolve) for a in body.get("args", [])])
    if kind == "AGG_FUNCTION":
        args = [to_column(a, resolve) for a in body.get("args", [])]
        return _AGGREGATES[body["name"].lower()](*(args or [F.lit(1)]))
    if kind == "WINDOW_FUNCTION":
        from pyspark.sql import Window

        w = Window.partitionBy(*map(resolve, body.get("partitionBy", []))).orderBy(*[resolve(c["name"]).desc() if c.get("desc") else resolve(c["name"]).asc() for c in body.get("orderBy", [])])
        return F.call_function(body["name"], *[to_column(a, resolve) for a in body.get("args", [])]).over(w)
    if kind in _BINARY:
        return _BINARY[kind](sub("leftExpr"), sub("rightExpr"))
    raise ValueError(f"unknown node {kind!r}")


def _value(datum: Any) -> Any:
    return datum["val"] if isinstance(datum, dict) else datum


def _constant(datum: Any) -> Column:
    if not isinstance(datum, dict):
        return F.lit(datum)
    kind = sql_type(datum.get("type", "TEXT"))
    return F.lit(None) if kind == "void" or datum["val"] is None else F.lit(datum["val"]).cast(kind)


def filter_rows(df: DataFrame, tree: str | dict) -> DataFrame:
    """Rows for which the tree is true."""
    return df.filter(to_column(tree))


def _fields(node: Any) -> list[str]:
    if isinstance(node, list):
        return [f for n in node for f in _fields(n)]
    if not isinstance(node, dict):
        return []
    if str(node.get("type", "")).upper() == "FIELD":
        c = node["body"]["column"]
        return [c if isinstance(c, str) else c["name"]]
    return [f for v in node.values() for f in _fields(v)]


def fields_by_table(tree: str | dict) -> dict[str, list[str]]:
    """Columns that a tree refers to, by table: the part of a name before its last dot."""
    out: dict[str, list[str]] = defaultdict(list)
    for name in _fields(json.loads(tree) if isinstance(tree, str) else tree):
        t, _, c = name.rpartition(".")
        if c not in out[t]:
            out[t].append(c)
    return dict(out)


def join_keys(tree: str | dict, left: str, right: str) -> list[tuple[str, str]]:
    """Pairs of columns of two tables that an AND of equalities makes equal."""
    node = json.loads(tree) if isinstance(tree, str) else tree
    kind, body = node["type"].upper(), node["body"]
    if kind == "AND":
        return join_keys(body["leftExpr"], left, right) + join_keys(body["rightExpr"], left, right)
    if kind != "EQUAL":
        return []
    (a,), (b,) = _fields(body["leftExpr"]) or [""], _fields(body["rightExpr"]) or [""]
    (ta, _, ca), (tb, _, cb) = a.rpartition("."), b.rpartition(".")
    return [(ca, cb)] if (ta, tb) == (left, right) else [(cb, ca)] if (tb, ta) == (left, right) else []
