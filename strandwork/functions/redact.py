"""Secrets out of nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def without(value: Column, kind: T.DataType, secret: set[str]) -> Column:
    """``value`` without fields and map keys whose names, in lower case, are in ``secret``, however deep; null stays null,
    and a struct that has nothing else becomes null."""
    if isinstance(kind, T.StructType):
        kept = [without(value[f.name], f.dataType, secret).alias(f.name) for f in kind if f.name.lower() not in secret]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without(x, kind.elementType, secret))
    if isinstance(kind, T.MapType):
        known = F.map_filter(value, lambda k, _: ~F.lower(k.cast("string")).isin(*secret))
        return F.transform_values(known, lambda _, v: without(v, kind.valueType, secret))
    return value


def redacted(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` without what is called by one of ``names``, columns and whatever is nested in others."""
    secret = {n.lower() for n in names}
    return rows.select(*[without(F.col(f"`{f.name}`"), f.dataType, secret).alias(f.name) for f in rows.schema if f.name.lower() not in secret])
