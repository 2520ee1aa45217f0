"""Unnesting that evaluates its array once.

A plain ``explode`` lets the optimizer derive "array is not empty" and push that
test below the projection, which computes an expensive array a second time.
The outer form has no such rewrite; its rows for empty arrays are dropped after.
"""

from pyspark.sql import Column, DataFrame, functions as F


def unnest(df: DataFrame, array, alias: str, *keep) -> DataFrame:
    array = F.col(array) if isinstance(array, str) else array
    return df.select(*keep, F.explode_outer(array).alias(alias)).filter(F.col(alias).isNotNull())


def unnest_fields(df: DataFrame, array, required: str, *keep) -> DataFrame:
    """One column per struct field; ``required`` is a field that is never null."""
    array = F.col(array) if isinstance(array, str) else array
    return df.select(*keep, F.inline_outer(array)).filter(F.col(required).isNotNull())


def unnest_numbered(df: DataFrame, array, position: str, alias: str, *keep) -> DataFrame:
    array = F.col(array) if isinstance(array, str) else array
    return (df.select(*keep, F.posexplode_outer(array).alias(position, alias))
            .filter(F.col(position).isNotNull()))


def struct_rows(items: Column, kind: str) -> Column:
    """Array of strings as an array of (kind, v)."""
    return F.transform(items, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))
