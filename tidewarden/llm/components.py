"""Connected components by alternating stars, for any number of links.

Every round is a few joins and groupings over the links; the result of a round is
written to the shared folder, so lineage stays short and a lost executor costs a
re-read.  A node with many links is a join key that Spark may split; no group is
ever gathered.
"""

from pyspark.sql import DataFrame, functions as F

from tidewarden.sources.stage import release, stage


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (a, b): the smallest node reachable.

    Repeated links, links to oneself and nulls count once or not at all.  No links:
    an empty frame.
    """
    now = stage(_turned(links.select("a", "b").dropna()).distinct())
    mark = _mark(now)
    while mark[0]:
        now, old = stage(_small_star(_large_star(now))), now
        release(old)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return (now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))


def _turned(links: DataFrame) -> DataFrame:
    """Larger node first."""
    return (links.filter("a <> b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    """Count and checksum: equal before and after a round that changes nothing."""
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h
