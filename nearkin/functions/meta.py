"""Typed metadata values: MAP<STRING, STRUCT<t, s, i, d, b>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

META_TYPE = "map<string,struct<t:string,s:string,i:bigint,d:double,b:boolean>>"
VALUE_TYPE = "struct<t:string,s:string,i:bigint,d:double,b:boolean>"


def typed(kind: str, value: Column) -> Column:
    """A value of kind ``s`` (string), ``i`` (integer), ``d`` (double) or ``b``."""
    parts = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
    fields = [F.lit(kind).alias("t"), *((value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in parts.items())]
    return F.struct(*fields).cast(VALUE_TYPE)


def meta_map(values: dict[str, Column]) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))).cast(META_TYPE)
