"""Row types for Arrow-batched functions, built without a running session."""

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}


def kind(name: str) -> T.DataType:
    """The type of that name; array<x> is an array."""
    return T.ArrayType(kind(name[6:-1])) if name.startswith("array<") else _KINDS[name]


def row(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, kind(k)) for name, k in columns.items()])
