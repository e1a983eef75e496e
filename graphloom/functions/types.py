"""Attribute types: names, Spark types and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of attribute types with their aliases.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "float": T.FloatType(),
    "float32": T.FloatType(),
    "integer": T.IntegerType(),
    "int": T.IntegerType(),
    "int32": T.IntegerType(),
    "unsignedinteger": T.LongType(),
    "uint": T.LongType(),
    "uint32": T.LongType(),
    "double": T.DoubleType(),
    "float64": T.DoubleType(),
    "category": T.IntegerType(),
    "data": T.BinaryType(),
    "json": T.StringType(),
    "biginteger": T.LongType(),
    "int64": T.LongType(),
    "unsignedbiginteger": T.DecimalType(20, 0),
    "uint64": T.DecimalType(20, 0),
}

#: A row's categories in order, with weights where the attribute has them.
MULTICATEGORY = T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("weight", T.FloatType())]))


def attribute_type(kind: str, dimension: int = 1) -> T.DataType:
    name = kind.lower().replace("_", "").replace(" ", "")
    if name == "multicategory":
        return MULTICATEGORY
    if name not in TYPES:
        raise ValueError(f"unknown attribute type {kind!r}")
    return TYPES[name] if dimension == 1 else T.ArrayType(TYPES[name], containsNull=False)


def default_value(f: T.StructField, dimension: int = 0) -> Column:
    """What a new row has: 0, false, an empty set; null for strings and the like."""
    t = f.dataType
    if isinstance(t, T.ArrayType):
        return F.array().cast(t) if isinstance(t.elementType, T.StructType) or not dimension else F.array_repeat(F.lit(0).cast(t.elementType), dimension)
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    if isinstance(t, T.NumericType):
        return F.lit(0).cast(t)
    return F.lit(None).cast(t)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.BooleanType))
