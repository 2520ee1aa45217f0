"""Mentions between documents, companies, suppliers and places as equi-joins.

A text is cut once into the word sequences (or character sequences) that a name
could equal; names then meet texts through a hash join, so neither side is ever
scanned once per row of the other.  All joins carry the portfolio id, which
keeps a document away from names it is not assessed against and spreads
frequent words over many keys.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import lexicon as L
from ..functions.text import extract_all
from ..sources.stage import stage
from .joins import HEAVY, split_join
from .rows import unnest

BOOK = ["portfolio_id"]
WORD = r"(?U)\w+"
KEY = 4


def name_surface(name: Column) -> Column:
    """Lower-cased name without punctuation at its ends.

    Deviation: a name such as "Acme Inc." is looked up as "acme inc"; with its
    final dot it could never end at a word boundary.
    """
    return F.regexp_replace(F.lower(name), r"(?U)^\W+|\W+$", "")


def name_words(surface: Column) -> Column:
    return F.size(extract_all(surface, WORD))


def _word_runs(text: Column, lengths: Column) -> Column:
    """Distinct runs of n consecutive words, separators kept, for each n of ``lengths``."""
    pieces = extract_all(F.regexp_replace(F.lower(text), r"(?U)^\W+", ""), r"(?U)\w+|\W+")

    def runs(tokens, n):
        words = F.floor((F.size(tokens) + 1) / 2).cast("int")
        return F.when(words >= n, F.transform(
            F.sequence(F.lit(0), words - n),
            lambda i: F.array_join(F.slice(tokens, 2 * i + 1, 2 * n - 1), "")))

    per_length = F.transform(F.array(pieces), lambda tokens: F.flatten(F.filter(
        F.transform(lengths, lambda n: runs(tokens, n)), lambda r: r.isNotNull())))
    return F.array_distinct(F.flatten(per_length))


def text_mentions(texts: DataFrame, names: DataFrame, doc: str, name: str,
                  group: list[str]) -> DataFrame:
    """Distinct (group, doc, name) where the name occurs in the text as whole words.

    texts: group, doc, text.  names: group, name, surface.  Exact for names of
    any length: texts are cut only into run lengths that some name has, read as
    a scalar subquery (a handful of small integers).
    """
    sized = names.filter(F.col("surface") != "").withColumn("_n", name_words(F.col("surface")))
    lengths = sized.filter(F.col("_n") > 0).agg(F.sort_array(F.collect_set("_n")).alias("l")).scalar()
    cut = texts.select(*group, doc, "text", lengths.alias("_lengths"))
    runs = unnest(cut, _word_runs(F.col("text"), F.col("_lengths")), "surface", *group, doc)
    return runs.join(sized.select(*group, name, "surface"), [*group, "surface"]) \
        .select(*group, doc, name).distinct()


def symbol_mentions(regs: DataFrame, holdings: DataFrame) -> DataFrame:
    """(portfolio_id, reg_id, symbol) for tickers named in a regulation."""
    names = holdings.select("portfolio_id", "symbol", F.lower("symbol").alias("surface"))
    return text_mentions(regs.select("portfolio_id", "reg_id", "text"), names,
                         "reg_id", "symbol", ["portfolio_id"])


def company_mentions(regs: DataFrame, holdings: DataFrame) -> DataFrame:
    """(portfolio_id, reg_id, symbol) for company names named in a regulation."""
    names = holdings.select("portfolio_id", "symbol", name_surface(F.col("company")).alias("surface"))
    return text_mentions(regs.select("portfolio_id", "reg_id", "text"), names,
                         "reg_id", "symbol", ["portfolio_id"])


def mentions(regs: DataFrame, holdings: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Both kinds in one pass over the texts: symbol_hit and company_hit per pair.

    ``coverage`` (reg_id, portfolio_id): texts come without a portfolio and are read once;
    what they say then meets the names of every portfolio covered.
    """
    names = holdings.select(
        "portfolio_id", "symbol", F.inline(F.array(
            F.struct(F.lit("s").alias("kind"), F.lower("symbol").alias("surface")),
            F.struct(F.lit("c").alias("kind"), name_surface(F.col("company")).alias("surface")))))
    if coverage is None:
        names = names.withColumn("who", F.struct("symbol", "kind"))
        hits = text_mentions(regs.select("portfolio_id", "reg_id", "text"), names,
                             "reg_id", "who", ["portfolio_id"])
    else:
        said = text_mentions(regs.select("reg_id", "text"), names.select("surface", F.col("surface").alias("said")).distinct(),
                             "reg_id", "said", [])
        hits = said.join(coverage, "reg_id").withColumnRenamed("said", "surface").join(
            names.withColumn("who", F.struct("symbol", "kind")), ["portfolio_id", "surface"])
    return hits.groupBy("reg_id", "portfolio_id", F.col("who.symbol").alias("symbol")).agg(
        F.bool_or(F.col("who.kind") == "s").alias("symbol_hit"),
        F.bool_or(F.col("who.kind") == "c").alias("company_hit"))


def _char_runs(text: Column, sizes: list[int]) -> Column:
    def runs(n):
        return F.when(F.length(text) >= n, F.transform(
            F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))
    return F.array_distinct(F.flatten(F.filter(
        F.array(*[runs(n) for n in sizes]), lambda r: r.isNotNull())))


def holding_suppliers(holdings: DataFrame) -> DataFrame:
    """One row per (portfolio, symbol, supplier); needs the ``suppliers`` column."""
    return unnest(holdings, "suppliers", "supplier", "portfolio_id", "symbol")


def anchor_word(words: Column) -> Column:
    """The longest word of a name (the first of equal ones)."""
    return F.reduce(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))


def supplier_mentions(regs: DataFrame, suppliers: DataFrame, group: list[str] = BOOK) -> DataFrame:
    """(group, reg_id, supplier) where the name is a substring of the text.

    ``group``: what regulation and supplier must have in common, by default the portfolio.

    A name inside a text puts its longest word inside one word of that text.
    That relation is found on the distinct vocabulary, through character runs;
    documents then meet it by their distinct words, and the full name is
    checked against the text inside the last join.  So the shuffled rows are
    distinct words per document, not character positions.
    """
    texts = regs.select(*group, "reg_id", F.lower("text").alias("low"))
    wanted = (suppliers.select(*group, "supplier").distinct()
              .withColumn("needle", F.lower("supplier"))
              .withColumn("anchor", anchor_word(extract_all(F.col("needle"), WORD))))
    doc_words = unnest(texts, F.array_distinct(extract_all(F.col("low"), WORD)), "word",
                       *group, "reg_id")
    sizes = list(range(1, KEY + 1))
    vocabulary = doc_words.select("word").distinct()
    runs = unnest(vocabulary, _char_runs(F.col("word"), sizes), "run", "word")
    anchors = wanted.select("anchor").distinct().withColumn("run", F.left("anchor", F.lit(KEY)))
    holds = (runs.join(anchors, "run").filter(F.contains("word", "anchor")).select("word", "anchor"))
    candidates = (doc_words.join(holds, "word").join(wanted, [*group, "anchor"])
                  .select(*group, "reg_id", "supplier", "needle").distinct())
    found = candidates.join(texts, [*group, "reg_id"]).filter(F.contains("low", "needle"))
    return found.select(*group, "reg_id", "supplier")


def places(regs: DataFrame, countries: list[str], group: list[str] = BOOK) -> DataFrame:
    """(group, reg_id, entity) for entity strings that name a country."""
    return unnest(regs, L.mentions_places(F.col("entities"), countries), "entity", *group, "reg_id")


def supplier_places(suppliers: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (supplier, entity_low) where the place string lies inside the supplier name.

    Names are short, so every run of one to four characters of a name is a join
    key; the whole place string is checked in the same row.
    """
    names = suppliers.select("supplier").distinct().withColumn("low", F.lower("supplier"))
    runs = unnest(names, _char_runs(F.col("low"), list(range(1, KEY + 1))), "run", "supplier", "low")
    wanted = (entities.select(F.lower("entity").alias("entity_low")).distinct()
              .withColumn("run", F.left("entity_low", F.lit(KEY))))
    return (runs.join(wanted, "run").filter(F.contains("low", "entity_low"))
            .select("supplier", "entity_low"))


def supplier_geo_pairs(regs: DataFrame, suppliers: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """(reg_id, portfolio_id, symbol, geo_pairs): place strings times suppliers that contain them.

    Counts are formed per (symbol, place) and per (document, place) before the
    two meet, so no (document, supplier, place) triple is ever written out.
    ``coverage``: see :func:`mentions`.
    """
    entities = places(regs, C.SUPPLY_COUNTRIES, BOOK if coverage is None else [])
    inside = supplier_places(suppliers, entities)
    by_symbol = (suppliers.join(inside, "supplier")
                 .groupBy("portfolio_id", "symbol", "entity_low").agg(F.count("*").alias("n_s")))
    entities = entities if coverage is None else entities.join(coverage, "reg_id")
    by_doc = (entities.groupBy("portfolio_id", "reg_id", F.lower("entity").alias("entity_low"))
              .agg(F.count("*").alias("n_e")))
    return (by_doc.join(by_symbol, ["portfolio_id", "entity_low"])
            .groupBy("reg_id", "portfolio_id", "symbol")
            .agg(F.sum(F.col("n_s") * F.col("n_e")).alias("geo_pairs")))


def supplier_counts(regs: DataFrame, suppliers: DataFrame, coverage: DataFrame | None = None, limit: int = HEAVY) -> DataFrame:
    """(reg_id, portfolio_id, symbol, supplier_hits): suppliers of a holding that a document names.

    ``coverage``: see :func:`mentions`.  A supplier that very many holdings or documents
    share is split (``limit``: rows of a key).
    """
    if coverage is None:
        found = supplier_mentions(regs, suppliers)
    else:
        found = supplier_mentions(regs, suppliers, []).join(coverage, "reg_id")
    return (split_join(stage(found), suppliers, ["portfolio_id", "supplier"], limit=limit)
            .groupBy("reg_id", "portfolio_id", "symbol").agg(F.count("*").alias("supplier_hits")))


def theme_hits(themes: DataFrame, held: DataFrame, limit: int = HEAVY) -> DataFrame:
    """Holdings (portfolio_id, symbol, risk_theme) with the regulations that target their theme.

    ``themes`` (reg_id, portfolio_id, risk_theme) and ``held`` are written tables.  A theme that most
    holdings of a portfolio share is split.
    """
    return split_join(held, themes, ["portfolio_id", "risk_theme"], limit=limit)


def region_hits(regions: DataFrame, exposure: DataFrame, limit: int = HEAVY) -> DataFrame:
    """Exposure (portfolio_id, symbol, region, share) with the regulations (reg_id, portfolio_id, region) that name its region.

    Both are written tables; a region that most holdings of a portfolio share is split.
    """
    return split_join(exposure, regions, ["portfolio_id", "region"], limit=limit)


def hit_regions(entities: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Exposure regions whose name lies inside a place string of a document.

    "US" does not hold "United States"; ``aliases`` may name further place
    strings that stand for a region, such as {"United States": ["US", "USA"]}.
    """
    named = L.mentions_places(entities, C.EXPOSURE_COUNTRIES)
    spots = F.array_join(F.transform(named, F.lower), "\n")

    def hit(region):
        found = F.contains(spots, F.lit(region.lower()))
        other = (aliases or {}).get(region)
        return found | F.arrays_overlap(named, F.array(*map(F.lit, other))) if other else found

    return F.array_compact(F.array(*[F.when(hit(r), F.lit(r)) for r in C.REGION_PATTERNS]))
