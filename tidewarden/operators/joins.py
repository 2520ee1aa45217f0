"""Joins of two tables with keys that a large share of the rows may hold."""

from pyspark.sql import DataFrame, functions as F

from ..sources.stage import stage

#: Rows of one key on one side beyond which the key is split.
HEAVY = 100_000
#: Heavy keys up to which they are broadcast: rows of a key and two numbers, some tens of MB.
SMALL = 1 << 20


def heavy_keys(left: DataFrame, right: DataFrame, keys: list[str], limit: int, both: bool) -> DataFrame:
    """(keys, _pl, _pr): pieces of each side for the keys with more than ``limit`` rows on one."""
    counts = left.groupBy(*keys).agg(F.count("*").alias("_nl")).join(
        right.groupBy(*keys).agg(F.count("*").alias("_nr")), keys)
    other = F.ceil(F.col("_nr") / limit) if both else F.lit(1)
    return (counts.select(*keys, F.ceil(F.col("_nl") / limit).cast("int").alias("_pl"), other.cast("int").alias("_pr"))
            .filter((F.col("_pl") > 1) | (F.col("_pr") > 1)))


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", limit: int = HEAVY) -> DataFrame:
    """``left.join(right, keys, how)`` in which no task meets more than about ``limit`` rows a side of one key.

    Keys are counted first.  Rows of a heavy key are dealt to pieces, and each piece meets
    every piece of the other side; all other keys are joined as they are, and without a
    heavy key this is the plain join.  Both frames are read twice, so they should be
    written tables or cheap to read.  ``how``: inner, or left, left_semi and left_anti,
    for which only the left side is split.  Null keys meet nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join can't be split")
    heavy = stage(heavy_keys(left, right, keys, limit, how == "inner"))
    n = heavy.count()
    if not n:
        return left.join(right, keys, how)
    heavy = F.broadcast(heavy) if n <= SMALL else heavy

    def dealt(df: DataFrame, mine: str, others: str, own: str, other: str) -> DataFrame:
        return (df.join(heavy, keys, "left")
                .withColumn(own, F.pmod(F.monotonically_increasing_id(), F.coalesce(mine, F.lit(1))).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1)))
                .drop("_pl", "_pr"))

    out = dealt(left, "_pl", "_pr", "_l", "_r").join(dealt(right, "_pr", "_pl", "_r", "_l"), [*keys, "_l", "_r"], how)
    return out.drop("_l", "_r")
