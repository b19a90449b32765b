"""Metadata filters: their text form and their meaning as a predicate."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.config import EngineError

#: Written operators; where several start at the same place the longest counts.
OPERATORS = {":": "eq", "=": "eq", "!=": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}
FIRST_OPERATOR = re.compile("|".join(sorted(map(re.escape, OPERATORS), key=len, reverse=True)))
INTEGER = re.compile(r"\s*[+-]?[0-9]+")
DOUBLE = re.compile(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")

Value = bool | int | float | str


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    values: tuple[Value, ...]


def read_value(text: str) -> Value:
    """Boolean, else integer, else finite double, else the text itself."""
    if text in ("true", "false"):
        return text == "true"
    if INTEGER.fullmatch(text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    if DOUBLE.fullmatch(text) and math.isfinite(float(text)):
        return float(text)
    return text


def parse_filter(text: str) -> list[Condition]:
    """Conditions that must all hold; empty clauses are passed over."""
    out = []
    for clause in filter(None, text.split(",")):
        at = FIRST_OPERATOR.search(clause)
        if not at or not at.start() or at.end() == len(clause):
            raise EngineError(f"no condition: {clause!r}")
        field, op, rest = clause[: at.start()], OPERATORS[at[0]], clause[at.end() :]
        if op == "eq" and len(rest) >= 5 and rest.startswith("in(") and rest.endswith(")"):
            items = rest[3:-1].split("|")
            if not all(items):
                raise EngineError(f"an empty choice: {clause!r}")
            out.append(Condition(field, "in", tuple(map(read_value, items))))
        else:
            out.append(Condition(field, op, (read_value(rest),)))
    return out


def parse_metadata(text: str) -> dict[str, Value]:
    """``key:value`` or ``key=value`` pairs; other operators are refused."""
    out: dict[str, Value] = {}
    for c in parse_filter(text):
        if c.op != "eq":
            raise EngineError(f"metadata is set with ':' or '=', not {c.op}")
        out[c.field] = c.values[0]
    return out


def compared(held: Column, value: Value, how) -> Column:
    """``how`` applied to the stored and the given value; null if the types don't compare."""
    if isinstance(value, bool):
        return F.when(held["t"] == "b", how(held["b"].cast("int"), F.lit(int(value))))
    if isinstance(value, int):
        return F.when(held["t"] == "i", how(held["i"], F.lit(value).cast("long"))).when(held["t"] == "d", how(held["d"], F.lit(float(value))))
    if isinstance(value, float):
        return F.when(held["t"].isin("i", "d"), how(F.coalesce(held["d"], held["i"].cast("double")), F.lit(value)))
    return F.when(held["t"] == "s", how(held["s"], F.lit(value)))


COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
}


def predicate(conditions: list[Condition], meta: str = "meta") -> Column:
    """True or false for every row. A field that isn't there fails all but
    ``!=``, which it passes; values whose types don't compare fail everything."""
    whole = F.lit(True)
    for c in conditions:
        held = F.element_at(F.col(meta), F.lit(c.field))
        if c.op == "in":
            test = F.lit(False)
            for v in c.values:
                test = test | F.coalesce(compared(held, v, COMPARE["eq"]), F.lit(False))
        else:
            test = F.coalesce(compared(held, c.values[0], COMPARE[c.op]), F.lit(False))
        whole = whole & F.coalesce(F.when(held.isNull(), F.lit(c.op == "ne")).otherwise(test), F.lit(False))
    return whole


def matching(metadata: DataFrame, conditions: list[Condition]) -> DataFrame:
    """(id) of the items with metadata that meets the conditions."""
    return metadata.where(predicate(conditions)).select("id")


def keep_matching(rows: DataFrame, metadata: DataFrame | None, text: str = "", key: str = "item_id") -> DataFrame:
    """Rows whose item meets the filter; an item without metadata meets only an empty one."""
    conditions = parse_filter(text)
    if not conditions or metadata is None:
        return rows
    return rows.join(matching(metadata, conditions).withColumnRenamed("id", key), key, "left_semi")
