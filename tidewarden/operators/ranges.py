"""Exact order statistics and running totals that never gather a whole group."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.stage import stage

#: Ranges of a group's values, as coarse ranges times fine ones in each.
COARSE, FINE = 32, 32
#: Distinct values up to which a group is one range.
FEW = 10_000


def _splitters(df: DataFrame, keys: list[str], value: str, few: int) -> DataFrame:
    """(keys, _s, _c): values that cut a group into ranges of about equal numbers of rows, and every FINE-th of them.

    Null for groups of at most ``few`` rows.
    """
    n = COARSE * FINE
    cut = F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(50 * n))
    found = df.groupBy(*keys).agg(F.when(F.count("*") > few, cut).alias("_s"))
    every = F.transform(F.sequence(F.lit(FINE), F.lit(n - 1), F.lit(FINE)), lambda i: F.element_at("_s", i))
    return found.withColumn("_c", F.when(F.col("_s").isNotNull(), every))


def _range(value: str) -> Column:
    """How many splitters lie below the value: first among the coarse ones, then among the fine ones there."""
    v = F.col(value).cast("double")
    coarse = F.size(F.filter("_c", lambda s: s < v))
    fine = F.filter(F.slice("_s", coarse * FINE + 1, FINE), lambda s: s < v)
    return F.when(F.col("_s").isNull(), F.lit(0)).otherwise(coarse * FINE + F.size(fine)).cast("int")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the same ``keys`` that come earlier by ``order`` (columns of any sortable type).

    Rows are range partitioned by keys and order, whatever shares a key or an order; sums
    of the partitions get a running total, and each row adds what comes before it in its
    partition.  Rows alike in ``order`` go by ``value``.  All columns of ``df`` are written
    once, so texts are best left out.
    """
    by = [*order, value]
    cut = stage(df.repartitionByRange(*keys, *by).withColumn("_b", F.spark_partition_id()))
    sums = cut.groupBy(*keys, "_b").agg(F.sum(value).alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_at"),
                          F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_b") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (cut.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, same)
            .withColumn(out, F.col("_off") + F.col("_in")).select(*df.columns, out))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], few: int = FEW) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    Equal values collapse to one counted row in a partial aggregation.  A group of more
    than ``few`` of them is cut into ranges with about as many each, wherever its values
    lie; the counts of the ranges locate each wanted rank, and only those ranges are
    ordered row by row.  Nulls and NaN are no values.
    """
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counted = df.filter(known).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cut = counted.join(_splitters(counted, keys, value, few), keys).withColumn("_b", _range(value)).drop("_s", "_c")
    hist = cut.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select(*keys, "_b", (F.sum("_n").over(upto) - F.col("_n")).alias("_from"),
                       F.sum("_n").over(upto).alias("_to"), F.sum("_n").over(per_key).alias("_total"))
    def rank(name, side, position):
        return F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), position.alias("rank"))

    last = F.col("_total") - 1
    ranks = F.explode(F.array(*[
        r for name, p in probs.items()
        for r in (rank(name, 0, F.floor(last * p)), rank(name, 1, F.ceil(last * p)))]))
    wanted = (hist.select("*", ranks.alias("_r"))
              .filter((F.col("_r.rank") >= F.col("_from")) & (F.col("_r.rank") < F.col("_to")))
              .groupBy(*keys, "_b", "_from", "_total").agg(F.collect_list("_r").alias("_ranks")))
    near = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = (cut.select(*keys, "_b", value, "_n").join(wanted, [*keys, "_b"])
              .withColumn("_end", F.col("_from") + F.sum("_n").over(near))
              .select(*keys, "_total", value, "_end", "_n", F.explode("_ranks").alias("_r"))
              .filter((F.col("_r.rank") < F.col("_end")) & (F.col("_r.rank") >= F.col("_end") - F.col("_n"))))

    def at(name, side):
        return F.max(F.when((F.col("_r.name") == name) & (F.col("_r.side") == side), F.col(value)))

    def point(name, p):
        part = (F.max("_total") - 1) * p
        low = at(name, 0)
        return (low + (at(name, 1) - low) * (part - F.floor(part))).alias(name)

    return placed.groupBy(*keys).agg(*[point(name, p) for name, p in probs.items()])
