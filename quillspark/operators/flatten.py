"""Flat columns from nested ones and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import ArrayType, StructType


def flattened(df: DataFrame, arrays_as_json: bool = True, sep: str = ".") -> DataFrame:
    """Struct fields become columns with dotted names; arrays and maps become JSON text if asked."""

    def leaves(schema: StructType, path: tuple[str, ...]):
        for f in schema:
            own = (*path, f.name)
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, own)
            else:
                c = F.col(".".join(f"`{p}`" for p in own))
                yield (F.to_json(c) if arrays_as_json and isinstance(f.dataType, ArrayType) else c).alias(sep.join(own))

    return df.select(*leaves(df.schema, ()))


def unflattened(df: DataFrame, schema: StructType, sep: str = ".") -> DataFrame:
    """The nested columns of `schema` from what flattened() made; NaN becomes null, JSON text becomes arrays."""

    def value(f, path: tuple[str, ...]) -> Column:
        own = (*path, f.name)
        if isinstance(f.dataType, StructType):
            return F.struct(*(value(g, own) for g in f.dataType)).alias(f.name)
        c = F.col(f"`{sep.join(own)}`")
        if isinstance(f.dataType, ArrayType) and df.schema[sep.join(own)].dataType.typeName() == "string":
            c = F.from_json(c, f.dataType)
        if f.dataType.typeName() in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        return c.alias(f.name)

    return df.select(*(value(f, ()) for f in schema))
