"""Schemas from short type names, without a running session."""

from __future__ import annotations

from pyspark.sql import types as T

TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "cost": T.DecimalType(38, 10),
}


def struct(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in columns.items()])
