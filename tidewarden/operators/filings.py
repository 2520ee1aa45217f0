"""Facts per filing and their rankings."""

from pyspark.sql import DataFrame, Window, functions as F

from .. import config as C
from ..functions import sections as S
from .rows import unnest_fields

EXPOSURE = "array<struct<region: string, share: double>>"
LISTS = ["suppliers", "risk_factors", "main_products", "dependencies", "key_customers",
         "manufacturing_locations"]


def section_index(filings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, number, heading, start, end): the segments of each filing in order.

    ``start`` and ``end`` are code points, from 0, the end exclusive; the line break
    before a heading belongs to no segment.  ``heading`` is null before the first one.
    A null text has no segment.
    """
    parts = filings.select(*keys, S.segments(F.col("text")).alias("_parts"))
    sizes = F.transform("_parts", lambda p: F.length(p) + 1)
    ends = F.reduce(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = F.transform("_parts", lambda p, i: F.struct(
        i.alias("number"), S.heading(p).alias("heading"), F.get("_ends", i).alias("start"),
        (F.get("_ends", i) + F.length(p)).alias("end")))
    return unnest_fields(parts.withColumn("_ends", ends), rows, "number", *keys)


def filing_facts(filings: DataFrame, keys: list[str], limits: S.Limits = S.Limits()) -> DataFrame:
    """Facts record of each filing text (columns ``keys`` and ``text``).

    Sections are cut once, intermediate matches are named columns, and every
    rule reads those; no shuffle and no Python.  ``limits``: nothing is cut by default.
    """
    def cut(name):
        if limits.windows is None:
            return S.headed(F.col("_parts"), F.col("_low_parts"), name)
        return S.section(F.col("text"), F.col("_low"), name, limits.windows.get(name, 3000))

    plain = {f"_sup{i}": cut(n) for i, n in enumerate(C.SUPPLIER_SECTIONS)}
    plain |= {f"_pro{i}": cut(n) for i, n in enumerate(C.PRODUCT_SECTIONS)}
    plain |= {"_risk": cut(C.RISK_SECTION), "_cust": cut(C.CUSTOMER_SECTION)}
    places = {f"_geo{i}": cut(n) for i, n in enumerate(C.GEOGRAPHY_SECTIONS)}
    places |= {"_site": cut(C.MANUFACTURING_SECTION)}

    def named(prefix):
        return [F.col(c) for c in plain if c.startswith(prefix)]

    geo = [(F.col(c), F.col(c + "_low")) for c in places if c.startswith("_geo")]
    if limits.windows is None:
        # Segments and their lower-cased forms as fields of one unnested row: named once, whatever reads them.
        first = filings.select(*keys, "text", S.segments(F.col("text")).alias("_cut")).select(*keys, "text", F.inline_outer(F.array(
            F.struct(F.col("_cut").alias("_parts"), F.transform("_cut", S.lowered).alias("_low_parts")))))
    else:
        first = filings.select(*keys, "text", S.lowered(F.col("text")).alias("_low"))
    return (first.select(*keys, "text", *[c.alias(n) for n, c in (plain | places).items()])
            .withColumns({f"{c}_low": S.lowered(F.col(c)) for c in places})
            .withColumns({"_hits": S.region_hits(geo), "_sentences": S.sentences(F.col("_risk"))})
            .select(*keys,
                    S.suppliers(*named("_sup"), n=limits.suppliers).alias("suppliers"),
                    S.geography(F.col("_hits")).alias("geographic_exposure"),
                    S.risk_factors(F.col("_sentences"), limits.risk_lines, limits.risk_chars).alias("risk_factors"),
                    S.products(*named("_pro"), n=limits.products).alias("main_products"),
                    S.dependencies(F.col("text"), limits.dependencies).alias("dependencies"),
                    S.customers(F.col("_cust"), limits.customers).alias("key_customers"),
                    S.sites(F.col("_site"), F.col("_site_low")).alias("manufacturing_locations"))
            .withColumn("revenue_by_region", F.col("geographic_exposure")))


def attach_facts(holdings: DataFrame, facts: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Left join on the ticker; a holding without filing gets empty facts."""
    out = holdings.join(facts.withColumnRenamed(ticker, "symbol"), "symbol", "left")
    empty = {c: F.coalesce(c, F.array().cast("array<string>")) for c in LISTS if c in out.columns}
    empty |= {c: F.coalesce(c, F.array().cast(EXPOSURE))
              for c in ("geographic_exposure", "revenue_by_region") if c in out.columns}
    return out.withColumns(empty)


def exposure_rank(facts: DataFrame, key: str) -> DataFrame:
    """Regions of each filing by share, largest first.

    A filing names at most ten regions, so the order is set inside the row.
    """
    ordered = F.transform(
        F.sort_array(F.transform("geographic_exposure", lambda e: F.struct(
            (-e["share"]).alias("neg"), e["region"].alias("region")))),
        lambda e, i: F.struct((i + 1).alias("rank"), e["region"].alias("region"),
                              (F.lit(0.0) - e["neg"]).alias("share")))
    return unnest_fields(facts, ordered, "rank", key)
