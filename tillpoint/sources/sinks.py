"""Result documents: every query result as JSON objects with the API's
camel-case field names (order_count -> orderCount)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def camel_type(kind: T.DataType) -> T.DataType:
    """The same type with camel-case names of nested fields.  Map keys are
    data and stay as they are."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(camel(f.name), camel_type(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(camel_type(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, camel_type(kind.valueType), kind.valueContainsNull)
    return kind


def to_json_documents(df: DataFrame, camel_case: bool = True) -> DataFrame:
    """One JSON object per row in column ``value`` (built by to_json on the
    executors; nested structs and arrays are kept, NULL fields written)."""
    cols = [F.col(f"`{f.name}`").cast(camel_type(f.dataType)).alias(camel(f.name)) if camel_case else F.col(f"`{f.name}`")
            for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, camel_case: bool = True) -> None:
    to_json_documents(df, camel_case).write.mode("overwrite").text(path)
