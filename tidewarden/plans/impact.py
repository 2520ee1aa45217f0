"""Score the holdings of a portfolio against the regulations that concern it.

``assess`` is the whole chain; the other functions are its steps.

Input frames
  holdings   portfolio_id, symbol, company, weight, rank, market_cap, ...
             optional risk_theme (kept when present)
  regulations  reg_id, portfolio_id, name + the extraction record
  coverage   reg_id, portfolio_id, if regulations come without a portfolio: each
             pair once, and every regulation is cleaned and extracted once
  facts      ticker + filing facts, one row per ticker
  findings   reg_id, symbol, finding (JSON)
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import lexicon as L, numbers as N, overrides as O, replies as R, scoring as S
from ..operators import extract as E, filings as FI, mentions as M
from ..operators.joins import HEAVY, split_join
from ..operators.rows import unnest
from ..sources.documents import pick_filings
from ..sources.stage import stage

#: Chosen filings up to which their names are broadcast: some tens of MB in a task.
NAMES = 1 << 16
#: Documents that a task extracts: about half a second.
DOCUMENTS = 300
PAIR = ["reg_id", "portfolio_id", "symbol"]
SCORE_COLUMNS = {"weight": 0.0, "market_cap": 0.0}


def prepare_holdings(holdings: DataFrame) -> DataFrame:
    """Default columns and the theme inferred from the company name."""
    df = N.ensure_columns(holdings, SCORE_COLUMNS | {"rank": F.lit(None).cast("int")})
    if "risk_theme" in df.columns:
        return df.withColumn("_own_theme", F.lit(True))
    return df.withColumns({"risk_theme": L.company_theme(F.col("company")), "_own_theme": F.lit(False)})


def regulation_features(regs: DataFrame, include_measure_themes: bool,
                        region_aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Everything about a regulation that is the same for all holdings, text left out."""
    cfg, low = F.col("cfg"), F.lower("text")

    def themes_of(words):
        return L.text_themes(F.lower(F.array_join(words, " ")), F.col("_rules"))

    sets = [O.targets_by(cfg, F.col("type_reg")), L.text_themes(low, F.col("_rules")),
            themes_of("entities")]
    if include_measure_themes:
        sets.append(themes_of("measures"))
    params = {f"p_{name}": O.param(cfg, name) for name in C.DEFAULT_PARAMS}
    return (regs.withColumns(params | {"_rules": O.text_rules(cfg)})
            .select(
                *[c for c in ("reg_id", "portfolio_id") if c in regs.columns],
                *params,
                L.targeted_themes(*sets).alias("targeted_themes"),
                S.measure_intensity(F.size("measures"), F.col("p_measure_intensity_scale"),
                                    F.col("p_measure_intensity_cap")).alias("intensity"),
                S.flag(F.col("penalty_hit"), F.col("p_penalty_boost")).alias("penalty"),
                S.flag(F.col("compliance_hit"), C.COMPLIANCE_BOOST).alias("compliance"),
                F.greatest(F.lit(1), F.col("p_ticker_min_len").cast("int")).alias("ticker_min_len"),
                M.hit_regions(F.col("entities"), region_aliases).alias("hit_regions"),
                F.when(cfg["company_theme_keywords"].isNotNull(), O.company_rules(cfg)).alias("company_rules")))


def assessment_pairs(holdings: DataFrame, features: DataFrame, limit: int = HEAVY) -> DataFrame:
    """Each regulation with each holding of the portfolios it concerns.

    Scoring every such pair is the result itself.  Regulation rows are small (no text);
    a portfolio with very many holdings or regulations is split by their numbers.
    """
    paired = split_join(holdings, features, ["portfolio_id"], limit=limit)
    own = F.when(F.col("_own_theme") | F.col("company_rules").isNull(), F.col("risk_theme")).otherwise(
        O.company_theme_by(F.col("company"), F.col("company_rules")))
    return paired.withColumn("risk_theme", own).drop("_own_theme", "company_rules")


def _with_mentions(pairs: DataFrame, regs: DataFrame, holdings: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    out = pairs.join(M.mentions(regs, holdings, coverage), PAIR, "left")
    return out.withColumns({
        "symbol_hit": F.coalesce("symbol_hit", F.lit(False)),
        "company_hit": F.coalesce("company_hit", F.lit(False)),
        "theme_hit": F.array_contains("targeted_themes", F.col("risk_theme")),
    })


def _rule_inputs(symbol_min_len: Column) -> dict[str, Column]:
    return {
        "intensity": F.col("intensity"), "penalty": F.col("penalty"), "compliance": F.col("compliance"),
        "mention_boost": F.col("p_mention_boost"), "theme_boost": F.col("p_theme_boost"),
        "symbol_hit": F.col("symbol_hit") & (F.length("symbol") >= symbol_min_len),
        "company_hit": F.col("company_hit"), "theme_hit": F.col("theme_hit"), "theme": F.col("risk_theme"),
    }


def _losses(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "loss_pct", S.loss_pct(F.col("risk_score"), F.col("p_loss_pct_multiplier"), F.col("p_max_loss_pct"))
    ).withColumn("loss", S.loss_amount(F.col("market_cap"), F.col("loss_pct")))


KEYS = ["reg_id", "portfolio_id", "symbol", "company", "rank", "weight", "market_cap", "risk_theme"]


def base_impact(holdings: DataFrame, regs: DataFrame, include_measure_themes: bool = True) -> DataFrame:
    """Base scoring: one mention boost, themes from measures included."""
    ready = prepare_holdings(holdings)
    pairs = assessment_pairs(ready, regulation_features(regs, include_measure_themes))
    scored = _with_mentions(pairs, regs, holdings)
    x = _rule_inputs(F.col("ticker_min_len"))
    scored = scored.withColumns({"risk_score": S.base_risk(x), "risk_drivers": S.base_drivers(x)})
    return _losses(scored).select(*KEYS, "risk_score", "loss_pct", "loss", "risk_drivers")


def full_impact(holdings: DataFrame, regs: DataFrame, facts: DataFrame,
                findings: DataFrame | None = None, include_measure_themes: bool = False,
                region_aliases: dict[str, list[str]] | None = None,
                coverage: DataFrame | None = None) -> DataFrame:
    """Blended scoring: direct, supply-chain and geographic risk, and findings if given.

    The suppliers of each book feed four joins and are written once.  ``coverage``:
    regulations without a portfolio meet those that it names.
    """
    ready = FI.attach_facts(prepare_holdings(holdings), facts.select(
        "ticker", F.size("suppliers").alias("n_suppliers"), "geographic_exposure"))
    suppliers = stage(unnest(facts, "suppliers", "supplier", F.col("ticker").alias("symbol")).join(
        holdings.select("portfolio_id", "symbol"), "symbol"))
    features = regulation_features(regs, include_measure_themes, region_aliases)
    if coverage is not None:
        features = stage(features.join(coverage, "reg_id"))
    pairs = assessment_pairs(ready, features)
    scored = (_with_mentions(pairs, regs, holdings, coverage)
              .join(M.supplier_counts(regs, suppliers, coverage), PAIR, "left")
              .join(M.supplier_geo_pairs(regs, suppliers, coverage), PAIR, "left"))
    if findings is None:
        scored = scored.withColumn("finding_risk", F.lit(0.0))
    else:
        scored = join_findings(scored, findings)
    zero = F.lit(0)
    scored = scored.withColumns({
        "direct_risk": S.direct_risk(_rule_inputs(F.lit(C.FULL_TICKER_MIN_LEN))),
        "supply_chain_risk": S.supply_risk(F.coalesce("supplier_hits", zero), F.coalesce("geo_pairs", zero)),
        "geographic_risk": S.geographic_risk(F.col("geographic_exposure"), F.col("hit_regions")),
    }).withColumn("risk_score", S.blended_risk(
        F.col("direct_risk"), F.col("supply_chain_risk"), F.col("geographic_risk"), F.col("finding_risk")))
    drivers = S.full_drivers(F.col("direct_risk"), F.col("supply_chain_risk"), F.col("geographic_risk"),
                             F.coalesce("n_suppliers", zero), F.col("geographic_exposure"))
    return _losses(scored).select(
        *KEYS, "direct_risk", "supply_chain_risk", "geographic_risk", "finding_risk", "risk_score",
        "loss_pct", "loss", drivers.alias("risk_drivers"))


def join_findings(scored: DataFrame, findings: DataFrame) -> DataFrame:
    """Left join of company findings; missing or unreadable ones count as zero."""
    parsed = findings.select("reg_id", "symbol", R.company_finding(F.col("finding")).alias("finding"))
    out = scored.join(parsed, ["reg_id", "symbol"], "left")

    def impact(name):
        return F.coalesce(f"finding.{name}", F.lit(0.0))

    return out.withColumn("finding_risk", S.finding_risk(
        impact("impact_direct"), impact("impact_suppliers"), impact("impact_geographic")))


def targeted_by_regulation(regs: DataFrame, include_measure_themes: bool = False) -> DataFrame:
    return regulation_features(regs, include_measure_themes).select(
        "reg_id", "portfolio_id", "targeted_themes")


@dataclass
class Assessment:
    """Tables of one assessment; ``scored`` is lazy until staged."""
    holdings: DataFrame
    regulations: DataFrame
    facts: DataFrame
    scored: DataFrame

    def staged(self) -> "Assessment":
        """The same with the scores written once, for several consumers."""
        return Assessment(self.holdings, self.regulations, self.facts, stage(self.scored))


def chosen_facts(filings: DataFrame, read: Callable[[DataFrame], DataFrame] | None = None,
                 names: DataFrame | None = None) -> DataFrame:
    """Facts of the one chosen filing per ticker (columns ticker, name, text).

    Up to NAMES chosen names are broadcast, so that no text is shuffled to meet them.  With
    a ``filing_id`` filings meet the chosen ids first, which Spark does before it makes
    columns that are computed, such as texts.  ``read``: the filings of a table of ids
    (``filing_id``), from a source that can leave out the others earlier than a join can.
    ``names``: ticker, name and filing_id of all filings and maybe of some that are none,
    where that is cheaper to tell; then the facts are a written table.  A ticker whose choice
    is none chooses again, among those of its names that are filings.
    """
    known = [c for c in ("filing_id",) if c in filings.columns]

    def of_ids(ids, few=False):
        # A partition of ids is small beside what they are looked up for, which need not be sorted.
        ids = F.broadcast(ids) if few else ids.hint("shuffle_hash") if read else ids
        return read(ids) if read else filings.join(ids, known, "left_semi")

    def chosen(files):
        return stage(pick_filings(files.select("ticker", "name", *known), *known))

    def facts_of(best):
        few = best.count() <= NAMES
        texts = of_ids(best.select(*known), few) if known else filings
        return FI.filing_facts(texts.join(F.broadcast(best) if few else best, ["ticker", "name"], "left_semi"), ["ticker"])

    if names is None:
        return facts_of(chosen(filings))
    best = chosen(names)
    found = stage(facts_of(best))
    missed = stage(best.join(found.select("ticker"), "ticker", "left_anti").select("ticker"))
    if missed.isEmpty():
        return found
    rest = stage(names.join(missed, "ticker", "left_semi").select(*known).distinct())
    again = chosen(of_ids(rest, rest.count() <= NAMES).join(missed, "ticker", "left_semi"))
    return stage(found.unionByName(facts_of(again)))


def dealt(documents: DataFrame) -> DataFrame:
    """The documents in tasks of at most about DOCUMENTS: texts are small for the time that reading them takes, so by
    their size thousands would go to one task."""
    documents = stage(documents)
    return documents.repartition(documents.count() // DOCUMENTS + 1)


def assess(holdings: DataFrame, documents: DataFrame, filings: DataFrame,
           company_findings: DataFrame | None = None,
           regulation_findings: DataFrame | None = None, coverage: DataFrame | None = None,
           read: Callable[[DataFrame], DataFrame] | None = None, names: DataFrame | None = None) -> Assessment:
    """Extract, read filings, merge supplied findings and score.

    Extraction and facts are each read by several joins, so they are written as
    tables first; an empty portfolio simply gives empty results.  With ``coverage``
    documents have no portfolio and are extracted once each, however many portfolios they
    concern; the regulations of the result then have a row per portfolio, without the text.
    ``read``, ``names``: see :func:`chosen_facts`.
    """
    if coverage is not None:
        documents = documents.drop("portfolio_id")
        coverage = stage(coverage.select("reg_id", "portfolio_id").dropna().distinct())
    regs = E.extract_documents(dealt(documents))
    if regulation_findings is not None:
        regs = E.merge_findings(regs, regulation_findings)
    facts = chosen_facts(filings, read, names)
    held, regs, facts = stage(holdings), stage(regs), stage(facts) if names is None else facts
    scored = full_impact(held, regs, facts, company_findings, coverage=coverage)
    if coverage is not None:
        regs = regs.drop("text").join(coverage, "reg_id")
    return Assessment(held, regs, facts, scored)
