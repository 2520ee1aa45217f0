"""Mixing sources to target weights by temperature.

Token shares are raised to an exponent and normalised.  The exponent is bisected on a
grid until the mix meets a target entropy or a limit on repetition; every trial is an
aggregate over the sources, of which only one row reaches the driver.  Weights then
become whole permutations of blocks: a source's documents are hashed to blocks, each
pass over a source deals its blocks in an order of its own, and the last pass stops
where the budget does.  Only that last block looks at documents one by one, so no task
holds a source.  Built-in functions only.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from tidewarden.sources.stage import stage

#: Largest number of times a document may be repeated, on average over its source.
MAX_EPOCHS = 2.0
#: Share of the largest possible entropy over sources that the mix should reach.
ENTROPY_SHARE = 0.97
#: Exponents are multiples of 1 / GRID.
GRID = 1 << 14
SEED = "mix-1"
#: A block is named by so many hex digits of a document's hash: 256 blocks a source.
_DIGITS = 2
#: Further digits of the blocks that the block where a budget ends is cut into.
_FINER = 3
#: Sources up to which the blocks where their budgets end are broadcast.
SMALL = 1 << 20
_BLANKS = " \t\n\x0b\x0c\r"


def _tokens(text: Column) -> Column:
    """Words between ASCII white space, counted as one more than the gaps between them."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, "[ \t-\r]+"))).cast("long")


def _hashed(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with mix_source, mix_hash (of seed and id) and mix_block."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    return (docs.withColumns({"mix_source": F.coalesce("source", F.lit("")), "mix_hash": key})
            .withColumn("mix_block", F.substring("mix_hash", 1, _DIGITS)))


def _dealt(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with mix_source, mix_tokens, mix_hash (of seed and id) and mix_block."""
    return _hashed(docs, seed).withColumn("mix_tokens", _tokens(F.col("text")))


def _trials(shares: DataFrame, exponents: list[float], repeats: float) -> list[tuple[float, float]]:
    """Entropy of the mix, and the most passes over a source, at each exponent; one pass over the shares for all."""
    e = F.col("e")
    each = shares.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("e"))
    rows = each.groupBy("e").agg(F.sum(F.pow("p", e)).alias("z"), F.sum(F.pow("p", e) * F.ln("p")).alias("s"),
                                 F.max(F.pow("p", e - 1)).alias("top")).collect()
    found = {r.e: (math.log(r.z) - r.e * r.s / r.z, repeats * r.top / r.z) for r in rows if r.z}
    return [found.get(x, (0.0, 0.0)) for x in exponents]


def bisected(holds, low: int = 0, high: int = GRID, at_once: int = 64) -> int:
    """Smallest whole number from ``low`` to ``high`` from which on it holds; ``high`` if none below is.

    ``holds``: of a list of numbers, at each; a bisection that looks at many points at once.
    """
    while low < high:
        step = -(-(high - low) // at_once)
        points = list(range(low, high, step))
        first = next((k for k, yes in enumerate(holds(points)) if yes), len(points))
        low, high = (points[first - 1] + 1 if first else low), (points[first] if first < len(points) else high)
    return high


def exponent_for(shares: DataFrame, repeats: float, max_epochs: float | None, entropy_share: float | None) -> float:
    """The exponent, from 0 (all sources alike) to 1 (as they are).

    The largest that reaches the entropy, unless the repetition limit needs a larger
    one.  ``repeats``: budget over tokens there are; above 1 even the shares as they
    are repeat, and the limit can't ask for less than that.
    """
    def at(ks: list[int]) -> list[tuple[float, float]]:
        return _trials(shares, [k / GRID for k in ks], repeats)

    most = 0.0
    if entropy_share is not None:
        goal = entropy_share * math.log(max(1, shares.count()))
        most = (bisected(lambda ks: [x < goal for x, _ in at(ks)], 0, GRID + 1) - 1) / GRID
    least = 0.0
    if max_epochs is not None:
        least = bisected(lambda ks: [x <= max_epochs for _, x in at(ks)]) / GRID
    return max(most, least, 0.0)


def plan(docs: DataFrame, budget: int | None = None, max_epochs: float | None = MAX_EPOCHS,
         entropy_share: float | None = ENTROPY_SHARE, seed: str = SEED) -> DataFrame:
    """One row per source, block and pass that deals documents of it.

    mix_source, mix_block, mix_epoch (from 0), mix_weight, mix_turn (place of the block
    in the pass) and mix_cut: null where the whole block is dealt, else the largest hash
    dealt.
    """
    sums = stage(_dealt(docs.select("doc_id", "source", "text"), seed).groupBy("mix_source", "mix_block")
                 .agg(F.sum("mix_tokens").alias("tokens")))
    per = sums.groupBy("mix_source").agg(F.sum("tokens").alias("held")).filter("held > 0")
    total = per.agg(F.sum("held").alias("t")).first().t or 0
    shares = stage(per.withColumn("p", F.col("held") / F.lit(float(max(total, 1)))))
    target = total if budget is None else budget
    exponent = exponent_for(shares, target / max(total, 1), max_epochs, entropy_share)
    mass = shares.agg(F.sum(F.pow("p", F.lit(exponent))).alias("z")).first().z or 1.0
    weight = F.pow("p", F.lit(exponent)) / F.lit(mass)
    quota = (shares.withColumn("weight", weight)
             .withColumn("quota", F.floor(F.col("weight") * F.lit(float(target)) + 0.5).cast("long"))
             .withColumns({"passes": F.expr("quota div held"), "rest": F.expr("quota % held")}))
    passes = quota.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    order = F.md5(F.concat_ws(":", F.lit(seed), "mix_source", F.col("epoch").cast("string"), "mix_block").cast("binary"))
    # At most 16 ** _DIGITS blocks meet in a window, whatever the source's size.
    run = Window.partitionBy("mix_source", "epoch").orderBy("place", "mix_block")
    turns = (passes.join(sums, "mix_source").withColumn("place", order)
             .withColumns({"turn": F.row_number().over(run) - 1, "upto": F.sum("tokens").over(run)}))
    turns = turns.select("mix_source", "mix_block", "epoch", "weight", "turn",
                         (F.col("epoch") < F.col("passes")).alias("whole"), "rest", "upto", "tokens")
    done = turns.filter("whole OR upto <= rest").withColumn("cut", F.lit(None).cast("string"))
    edge = turns.filter("NOT whole AND upto > rest AND upto - tokens <= rest").withColumn("room", F.expr("rest - upto + tokens"))
    # The one block of a source where the budget ends: by finer blocks, then by document in the one where it ends.
    edge = stage(edge)
    texts = docs.select("doc_id", "source", "text")
    # One row a source: where that is few, words are counted only in these blocks; else before rows move, so no text does.
    if edge.count() <= SMALL:
        inner = _hashed(texts, seed).join(F.broadcast(edge.select("mix_source", "mix_block", "room")), ["mix_source", "mix_block"])
        inner = inner.withColumn("mix_tokens", _tokens(F.col("text")))
    else:
        inner = _dealt(texts, seed).drop("text").join(edge.select("mix_source", "mix_block", "room"), ["mix_source", "mix_block"])
    inner = stage(inner.select("mix_source", "mix_block", "room", "mix_hash", "mix_tokens",
                               F.substring("mix_hash", 1, _DIGITS + _FINER).alias("sub")))
    key = ["mix_source", "mix_block"]
    finer = (inner.groupBy(*key, "room", "sub").agg(F.sum("mix_tokens").alias("tokens"), F.max("mix_hash").alias("cut"))
             .withColumn("upto", F.sum("tokens").over(Window.partitionBy(*key).orderBy("sub"))))
    ends = (finer.filter("upto > room AND upto - tokens <= room")
            .select(*key, "sub", (F.col("room") - F.col("upto") + F.col("tokens")).alias("left")))
    inside = Window.partitionBy(*key, "sub").orderBy("mix_hash").rangeBetween(Window.unboundedPreceding, 0)
    dealt = (inner.drop("room").join(ends, [*key, "sub"]).withColumn("upto", F.sum("mix_tokens").over(inside)).filter("upto <= left")
             .select(*key, F.col("mix_hash").alias("cut")))
    cuts = finer.filter("upto <= room").select(*key, "cut").unionByName(dealt).groupBy(*key).agg(F.max("cut").alias("cut"))
    last = edge.join(cuts, ["mix_source", "mix_block"])
    keep = ["mix_source", "mix_block", *[F.col(c).alias(f"mix_{c}") for c in ("epoch", "weight", "turn", "cut")]]
    return done.select(*keep).unionByName(last.select(*keep))


def mixed(docs: DataFrame, budget: int | None = None, max_epochs: float | None = MAX_EPOCHS,
          entropy_share: float | None = ENTROPY_SHARE, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix deals, once per pass, with mix_epoch, mix_turn, mix_weight and mix_tokens.

    ``budget``: tokens of the mix, by default as many as there are.  Never over a
    source's share; below it by less than one document.  A null source is a source of
    its own, named ""; a text without a word costs nothing and goes with its block; a
    source without any word is left out.  Rows that repeat an id go together; rows
    without an id share one hash.  An empty table gives no rows.  Columns of ``docs``
    whose names start with "mix_" are dropped.
    """
    plain = docs.select(*[c for c in docs.columns if not c.startswith("mix_")])
    deal = stage(plan(plain, budget, max_epochs, entropy_share, seed))
    rows = _dealt(plain, seed).join(deal, ["mix_source", "mix_block"])
    rows = rows.filter("mix_cut IS NULL OR mix_hash <= mix_cut")
    return rows.select(*plain.columns, "mix_epoch", "mix_turn", "mix_weight", "mix_tokens")


def resampled(docs: DataFrame, **how) -> DataFrame:
    """:func:`mixed` with the columns of ``docs`` only: each row as often as it is dealt."""
    return mixed(docs, **how).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, epoch, turn, tokens of every document dealt, and the source's weight to six places."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "source", F.col("mix_epoch").cast("long").alias("epoch"),
                              F.col("mix_turn").cast("long").alias("turn"), F.col("mix_tokens").alias("tokens"),
                              F.round("mix_weight", 6).alias("weight"))


def oracle() -> str:
    """Every exponent of the grid is tried instead of bisecting; all documents are ranked in one window."""
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(source, '') AS src, md5('{SEED}:' || doc_id) AS h,
                 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
    s AS (SELECT src, sum(tokens) AS held FROM d GROUP BY src HAVING sum(tokens) > 0),
    p AS (SELECT src, held, held / (SELECT sum(held) FROM s)::DOUBLE AS p FROM s),
    trial AS (SELECT k, ln(sum(pow(p, k / {GRID}.0))) - k / {GRID}.0 * sum(pow(p, k / {GRID}.0) * ln(p)) / sum(pow(p, k / {GRID}.0)) AS entropy,
                max(pow(p, k / {GRID}.0 - 1)) / sum(pow(p, k / {GRID}.0)) AS passes FROM p, range({GRID + 1}) AS g(k) GROUP BY k),
    best AS (SELECT greatest((SELECT coalesce(max(k), 0) FROM trial WHERE entropy >= {ENTROPY_SHARE} * (SELECT ln(count(*)) FROM s)),
                             (SELECT min(k) FROM trial WHERE passes <= {MAX_EPOCHS})) / {GRID}.0 AS a),
    w AS (SELECT src, held, pow(p, a) / (SELECT sum(pow(p, a)) FROM p, best) AS weight FROM p, best),
    q AS (SELECT *, floor(weight * (SELECT sum(held) FROM s)::DOUBLE + 0.5)::BIGINT AS quota FROM w),
    e AS (SELECT src, weight, quota, unnest(range((quota // held + 1)::BIGINT)) AS epoch, quota // held AS passes, quota % held AS rest FROM q),
    b AS (SELECT src, substr(h, 1, {_DIGITS}) AS block, sum(tokens) AS tokens FROM d GROUP BY ALL),
    t AS (SELECT e.*, block, row_number() OVER o - 1 AS turn FROM e JOIN b USING (src)
          WINDOW o AS (PARTITION BY src, epoch ORDER BY md5('{SEED}:' || src || ':' || epoch || ':' || block), block)),
    r AS (SELECT doc_id, source, epoch, turn, d.tokens, weight, passes, rest,
            sum(d.tokens) OVER (PARTITION BY d.src, epoch ORDER BY turn, h RANGE UNBOUNDED PRECEDING) AS upto,
            sum(d.tokens) OVER (PARTITION BY d.src, epoch, turn) AS in_block
          FROM d JOIN t ON d.src = t.src AND substr(h, 1, {_DIGITS}) = block)
    SELECT doc_id, source, epoch, turn, tokens, round(weight, 6) AS weight FROM r WHERE epoch < passes OR upto <= rest"""
