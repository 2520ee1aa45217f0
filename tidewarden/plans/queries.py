"""One query per operator over a folder of driver tables.

Arrays leave as joined text and doubles rounded, so that two engines can be
compared value by value.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import config as C
from ..fixtures import Inputs
from ..functions import lexicon as L, numbers as N, overrides as O, replies as R, scoring as S, sections as SE, text as T
from ..operators import datasets as D, extract as E, filings as FI, mentions as M, passages as P
from ..operators import portfolio as PF, ranking as RK, recommend as RC
from ..operators.rows import unnest, unnest_fields
from ..sources.stage import scratch, stage
from ..sources import documents as SD, facts as SF, filing_store as FS, tables as ST
from . import impact as I, report as RP

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return fn


def joined(c) -> Column:
    return F.array_join(c, "|")


def r6(c) -> Column:
    """Six decimals.  Means often end exactly on a rounding tie; the small offset
    settles it the same way on every engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(3e-10), 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def billions(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c) / 1e9) for c in cols})


# ---------------------------------------------------------------- inputs

def portfolio(x: Inputs) -> DataFrame:
    return PF.merge_portfolio(x["holdings"].drop("k"), x["fundamentals"])


def cleaned(x: Inputs) -> DataFrame:
    return E.clean_documents(I.dealt(x["regulation_docs"]))


def extracted(x: Inputs) -> DataFrame:
    return E.extract(cleaned(x))


def facts(x: Inputs) -> DataFrame:
    return I.chosen_facts(x["filings"], x.filings_of)


def all_facts(x: Inputs) -> DataFrame:
    return FI.filing_facts(x["filings"], ["filing_id"])


def base(x: Inputs) -> DataFrame:
    return I.base_impact(stage(portfolio(x)), stage(extracted(x)))


def assessed(x: Inputs) -> I.Assessment:
    return I.assess(portfolio(x), x["regulation_docs"], x["filings"], x["company_findings"], read=x.filings_of,
                    names=x["filing_names"])


def full(x: Inputs) -> DataFrame:
    return assessed(x).scored


# ---------------------------------------------------------------- sources

@query
def holdings_load(x):
    path = scratch(x.spark)
    x["holding_strings"].select("rank", "company", "symbol", "weight", "price", "portfolio_id") \
        .write.option("header", True).option("escape", '"').csv(path)
    return ST.order_holdings(ST.read_holdings(x.spark, path, ("portfolio_id",)))


@query
def fundamentals_load(x):
    path = scratch(x.spark)
    raw = x["fundamental_strings"].select(ST.FUNDAMENTAL_COLUMNS).toDF(*ST.FUNDAMENTAL_HEADER)
    (raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return ST.read_fundamentals(x.spark, path)


@query
def filing_pick(x):
    return SD.pick_filings(x["every_filing"].select("ticker", "name"))


@query
def reg_docs_load(x):
    # One folder per document, so that the written part files carry its name.
    path = scratch(x.spark)
    SD.write_documents(x["regulation_docs"].select("name", "text"), path)
    docs = SD.read_regulations(x.spark, path, F.regexp_extract("path", "name=([^/]+)/", 1))
    pasted = x["model_replies"].select(F.col("reply").alias("text"))
    return (SD.add_pasted(docs, pasted)
            .select("name", "ext", T.normalize_space(F.col("text")).alias("text")))


@query
def reg_concat(x):
    return E.corpus_offsets(x["regulation_docs"].select("portfolio_id", "reg_id", "ord", "text"),
                            "portfolio_id", ["ord", "reg_id"]).select("portfolio_id", "reg_id", "n_chars", "start_pos")


@query
def reg_corpus(x):
    return E.combine(extracted(x), "portfolio_id").select(
        "portfolio_id", "type_reg", "penalty_hit", "compliance_hit", "n_docs", joined("entities").alias("entities"),
        joined("dates").alias("dates"), joined("measures").alias("measures"))


def facts_out(df: DataFrame, *keys: str) -> DataFrame:
    shares = F.transform("geographic_exposure", lambda e: F.concat(
        e["region"], F.lit("="), e["share"].cast("int").cast("string")))
    return df.select(
        *keys, *[joined(c).alias(c) for c in FI.LISTS], joined(shares).alias("geographic_exposure"))


@query
def facts_roundtrip(x):
    path = scratch(x.spark)
    SF.write_facts(facts(x), path, "json")
    return facts_out(SF.read_facts(x.spark, path, "json"), "ticker")


# ---------------------------------------------------------------- repair

@query
def decimal_comma_cast(x):
    return x["holding_strings"].select("symbol", N.decimal_comma(F.col("weight")).alias("weight"),
                                       N.decimal_comma(F.col("price")).alias("price"))


@query
def strip_clean(x):
    padded = x["holding_strings"].select(
        "symbol", "company", F.concat(F.lit("\t "), F.col("company"), F.lit("\n ")).alias("padded"))
    return padded.select("symbol", N.unquote(F.col("company")).alias("company"),
                         N.strip(F.col("padded")).alias("stripped"))


@query
def numeric_coerce(x):
    return x["fundamental_strings"].select("symbol", *[N.thousands(F.col(c)).alias(c) for c in ST.NUMERIC])


@query
def margins(x):
    return x["fundamentals"].select(
        "symbol", r6(N.ratio(F.col("op_income"), F.col("revenue"))).alias("op_margin"),
        r6(N.ratio(F.col("net_income"), F.col("revenue"))).alias("net_margin"))


@query
def portfolio_merge(x):
    return rounded(portfolio(x).select(
        "portfolio_id", "symbol", "company", "weight", "price", "market_cap", "revenue", "op_income",
        "net_income", "eps", "fcf", "op_margin", "net_margin", "risk_score", "loss_pct", "loss"),
        "op_margin", "net_margin")


@query
def risk_bands(x):
    scored = full(x)
    return PF.risk_bands(scored).select("reg_id", "symbol", r6("risk_score").alias("risk_score"), "band")


# ---------------------------------------------------------------- text

@query
def html_clean(x):
    return x.table("pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query
def html_strip_simple(x):
    return x.table("pages").select("page_id", T.html_strip_simple(F.col("html")).alias("text"))


@query
def xml_text(x):
    docs = x["regulation_docs"].filter(F.col("ext") == "xml")
    return docs.select("reg_id", T.xml_text(O.without_config(F.col("text"))).alias("text"))


@query
def whitespace_norm(x):
    return x.table("documents").select("doc_id", T.normalize_space(F.col("text")).alias("text"))


@query
def inline_config(x):
    docs = x["regulation_docs"].select(
        "reg_id", O.parse_config(O.config_json(F.col("text"))).alias("cfg"),
        O.without_config(F.col("text")).alias("body"))
    return docs.select(
        "reg_id", O.param(F.col("cfg"), "mention_boost").alias("mention_boost"),
        O.param(F.col("cfg"), "loss_pct_multiplier").alias("loss_pct_multiplier"),
        O.param(F.col("cfg"), "max_loss_pct").alias("max_loss_pct"), "body")


@query
def config_overlay(x):
    # Themes of the holdings and targets under the dictionaries of each document.
    regs = stage(extracted(x))
    scored = I.base_impact(stage(portfolio(x)), regs)
    return scored.select("reg_id", "symbol", "risk_theme").join(
        I.targeted_by_regulation(regs, True).select(
            "reg_id", joined("targeted_themes").alias("targeted_themes")), "reg_id")


@query
def mask_citations(x):
    return cleaned(x).select("reg_id", T.mask_citations(F.col("text")).alias("text"))


@query
def date_mentions(x):
    return unnest(cleaned(x), T.date_mentions(F.col("text")), "date", "reg_id")


@query
def context_years(x):
    return cleaned(x).select("reg_id", joined(F.sort_array(
        T.context_years(T.mask_citations(F.col("text"))))).alias("years"))


@query
def entity_gazetteer(x):
    return cleaned(x).select("reg_id", joined(F.sort_array(
        L.gazetteer_matches(F.col("text"), C.ENTITY_LABELS))).alias("entities"))


@query
def entity_keywords(x):
    return cleaned(x).select("reg_id", joined(F.sort_array(L.keyword_entities(F.col("text")))).alias("entities"))


@query
def measure_phrases(x):
    return cleaned(x).select("reg_id", joined(F.sort_array(L.measure_phrases(F.col("text")))).alias("measures"))


@query
def measure_fallback(x):
    return cleaned(x).select("reg_id", joined(F.sort_array(L.measure_fallback(F.col("text")))).alias("measures"))


@query
def regulation_type(x):
    return x.table("documents").select("doc_id", L.regulation_type(F.lower("text")).alias("type_reg"))


@query
def company_theme(x):
    return x["holdings"].select("symbol", L.company_theme(F.col("company")).alias("theme"))


@query
def text_themes(x):
    rules = L.theme_rules({"the": "Common", "tion": "Suffix", "ung": "German", "ai": "Technology",
                           "eau": "French", "zzz": "Never"})
    return x.table("documents").select("doc_id", joined(L.text_themes(F.lower("text"), rules)).alias("themes"))


@query
def targeted_themes(x):
    return I.targeted_by_regulation(extracted(x)).select(
        "reg_id", joined("targeted_themes").alias("targeted_themes"))


@query
def passages(x):
    return P.passages(x.table("documents"), ["doc_id"], 300, 100)


@query
def reg_extract(x):
    return extracted(x).select("reg_id", "type_reg", joined("entities").alias("entities"),
                               joined("dates").alias("dates"), joined("measures").alias("measures"),
                               "penalty_hit", "compliance_hit")


@query
def reg_digest(x):
    return E.digest(extracted(x)).withColumns({
        "top_entities": joined("top_entities"), "top_dates": joined("top_dates")})


@query
def measure_freq(x):
    return E.measure_frequency(extracted(x))


# ---------------------------------------------------------------- filings

@query
def section_slice(x):
    low = x["every_filing"].select("filing_id", "text", SE.lowered(F.col("text")).alias("low"))
    return low.select("filing_id", *[
        SE.section(F.col("text"), F.col("low"), name, 120).alias(alias)
        for alias, name in (("supply", "supply chain"), ("customers", "customers"), ("first", "form 10-k"),
                            ("absent", "no such heading"))])


@query
def filing_sections(x):
    return FI.section_index(x["filings"], ["filing_id"])


def _fact(x, name):
    return all_facts(x).select("filing_id", joined(name).alias(name))


@query
def filing_suppliers(x):
    return _fact(x, "suppliers")


@query
def filing_geography(x):
    return unnest_fields(all_facts(x), "geographic_exposure", "region", "filing_id")


@query
def filing_risks(x):
    return unnest(all_facts(x), "risk_factors", "risk_factor", "filing_id")


@query
def filing_products(x):
    return _fact(x, "main_products")


@query
def filing_dependencies(x):
    return _fact(x, "dependencies")


@query
def filing_customers(x):
    return _fact(x, "key_customers")


@query
def filing_sites(x):
    return _fact(x, "manufacturing_locations")


@query
def filing_facts(x):
    return facts_out(FI.attach_facts(x["holdings"].select("symbol"), facts(x)), "symbol")


@query
def exposure_rank(x):
    return FI.exposure_rank(facts(x), "ticker")


# ---------------------------------------------------------------- mentions

@query
def mention_symbol(x):
    return M.symbol_mentions(cleaned(x), x["holdings"]).select("reg_id", "symbol")


@query
def mention_company(x):
    return M.company_mentions(cleaned(x), x["holdings"]).select("reg_id", "symbol")


@query
def theme_hits(x):
    themes = unnest(I.targeted_by_regulation(extracted(x)), "targeted_themes", "risk_theme",
                    "reg_id", "portfolio_id")
    held = x["holdings"].select("portfolio_id", "symbol", L.company_theme(F.col("company")).alias("risk_theme"))
    return M.theme_hits(stage(themes), stage(held)).select("reg_id", "symbol", "risk_theme")


def book_suppliers(x):
    return stage(M.holding_suppliers(x["holdings"].join(
        facts(x).select(F.col("ticker").alias("symbol"), "suppliers"), "symbol")))


@query
def supplier_mentions(x):
    return M.supplier_counts(stage(cleaned(x)), book_suppliers(x)).select("reg_id", "symbol", "supplier_hits")


@query
def supplier_geo_pairs(x):
    return M.supplier_geo_pairs(stage(extracted(x)), book_suppliers(x)).select("reg_id", "symbol", "geo_pairs")


@query
def region_hits(x):
    regs = unnest(extracted(x), M.hit_regions(F.col("entities")), "region", "reg_id", "portfolio_id")
    held = x["holdings"].select("portfolio_id", "symbol").join(
        unnest_fields(facts(x), "geographic_exposure", "region", F.col("ticker").alias("symbol")), "symbol")
    return M.region_hits(stage(regs), stage(held)).select("reg_id", "symbol", "region", "share")


@query
def safe_themes(x):
    return RC.safe_themes(PF.theme_concentration(base(x))).select(
        "reg_id", "risk_theme", joined("target_sectors").alias("target_sectors"))


@query
def model_findings_join(x):
    pairs = x["holdings"].join(x["regulation_docs"].select("reg_id", "portfolio_id"), "portfolio_id")
    return I.join_findings(pairs, x["company_findings"]).select(
        "reg_id", "symbol",
        F.coalesce("finding.impact_direct", F.lit(0.0)).alias("impact_direct"),
        F.coalesce("finding.impact_suppliers", F.lit(0.0)).alias("impact_suppliers"),
        F.coalesce("finding.impact_geographic", F.lit(0.0)).alias("impact_geographic"),
        F.coalesce("finding.action", F.lit(C.FINDING_HOLD)).alias("action"),
        F.coalesce("finding.reason", F.lit(C.FINDING_UNAVAILABLE)).alias("reason"))


@query
def supply_findings(x):
    parsed = x["supply_findings"].select("symbol", R.supply_finding(F.col("finding")).alias("f"))
    return parsed.select("symbol", "f.risk_level", "f.risk_score", joined("f.affected_suppliers").alias("suppliers"),
                         F.col("f.geographic_risks")["China"].alias("china_risk"))


# ---------------------------------------------------------------- scores

@query
def measure_intensity(x):
    return rounded(I.regulation_features(extracted(x), False).select("reg_id", "intensity"), "intensity")


@query
def base_risk(x):
    return rounded(base(x).select("reg_id", "symbol", "risk_theme", "risk_score"), "risk_score")


def _scores(x, *cols):
    return rounded(full(x).select("reg_id", "symbol", *cols), *cols)


@query
def direct_risk(x):
    return _scores(x, "direct_risk")


@query
def supply_chain_risk(x):
    return _scores(x, "supply_chain_risk")


@query
def geographic_risk(x):
    return _scores(x, "geographic_risk")


@query
def model_risk(x):
    return _scores(x, "finding_risk")


@query
def coverage_risk(x):
    """Regulations that concern several portfolios; each is read once."""
    a = I.assess(portfolio(x), x["regulation_docs"], x["filings"], coverage=x["coverage"], read=x.filings_of,
                 names=x["filing_names"])
    return rounded(a.scored.select("reg_id", "portfolio_id", "symbol", "risk_theme", "direct_risk", "supply_chain_risk",
                                   "geographic_risk", "risk_score"),
                   "direct_risk", "supply_chain_risk", "geographic_risk", "risk_score")


@query
def coverage_themes(x):
    a = I.assess(portfolio(x), x["regulation_docs"], x["filings"], coverage=x["coverage"], read=x.filings_of,
                 names=x["filing_names"])
    return rounded(PF.theme_concentration(a.scored).drop("est_loss"), "weight_exposure", "avg_risk", "max_risk")


@query
def blended_risk(x):
    return _scores(x, "risk_score")


@query
def safe_themes_blended(x):
    return RC.safe_themes(PF.theme_concentration(full(x))).select(
        "reg_id", "risk_theme", joined("target_sectors").alias("target_sectors"))


@query
def loss_estimate(x):
    return billions(rounded(full(x).select("reg_id", "symbol", "loss_pct", "loss"), "loss_pct"), "loss")


@query
def risk_drivers(x):
    return base(x).select("reg_id", "symbol", "risk_drivers")


@query
def risk_drivers_full(x):
    return full(x).select("reg_id", "symbol", "risk_drivers")


@query
def extraction_merge(x):
    merged = E.merge_findings(extracted(x), x["regulation_findings"])
    return merged.select(
        "reg_id", "type_reg", joined("entities").alias("entities"), joined("dates").alias("dates"),
        joined("measures").alias("measures"), "severity", "summary",
        F.col("finding_status.enabled").alias("enabled"), F.col("finding_status.error").alias("error"))


# ---------------------------------------------------------------- aggregates

@query
def portfolio_risk(x):
    return rounded(PF.portfolio_risk(full(x)), "portfolio_risk")


@query
def theme_concentration(x):
    return billions(rounded(PF.theme_concentration(full(x)), "weight_exposure", "avg_risk", "max_risk"), "est_loss")


@query
def portfolio_summary(x):
    s = PF.portfolio_summary(full(x))
    return billions(rounded(s.select(
        "reg_id", "portfolio_id", "portfolio_risk", "total_market_cap", "total_loss",
        F.size("concentration").alias("n_themes"),
        joined(F.transform("concentration", lambda c: F.concat(
            c["risk_theme"], F.lit(":"), c["n_holdings"].cast("string")))).alias("themes")), "portfolio_risk"),
        "total_market_cap", "total_loss")


@query
def kpis(x):
    return billions(rounded(PF.kpis(full(x)), "avg_risk"), "total_loss")


@query
def dominant_theme(x):
    return PF.dominant_theme(PF.theme_concentration(full(x)))


@query
def risk_stats(x):
    return rounded(PF.risk_stats(stage(full(x))), "mean_risk", "median_risk")


@query
def attention_zone(x):
    return rounded(PF.attention_zone(stage(full(x))), "max_weight", "weight_q75", "risk_q75")


@query
def risk_histogram(x):
    return PF.histogram(full(x))


@query
def risk_correlation(x):
    return PF.correlations(full(x)).withColumn("corr", F.round("corr", 4))


@query
def market_snapshot(x):
    return PF.market_snapshot(portfolio(x)).select(
        "n_holdings", r6(F.col("total_market_cap") / 1e9).alias("total_market_cap"),
        joined(F.transform("sample", lambda s: s["symbol"])).alias("sample"))


# ---------------------------------------------------------------- rankings

@query
def top_risks(x):
    return rounded(RK.top_risks(full(x)).select("reg_id", "position", "symbol", "risk_score"), "risk_score")


@query
def top_impacted(x):
    return billions(rounded(RK.top_impacted(full(x)), "risk_score", "direct_risk", "supply_chain_risk",
                            "geographic_risk", "loss_pct"), "loss")


@query
def next_deadline(x):
    return RK.next_deadline(extracted(x)).withColumn("next_deadline", F.col("next_deadline").cast("string"))


# ---------------------------------------------------------------- advice

@query
def recommendations(x):
    a = assessed(x).staged()
    rows = RC.rule_recommendations(a.scored, a.regulations)
    return rows.select("reg_id", "action", "position", "ticker", "from_sector", "urgency",
                       r6("risk_score").alias("risk_score"))


@query
def portfolio_advice(x):
    regs = stage(extracted(x))
    scored = stage(I.base_impact(stage(portfolio(x)), regs))
    return RC.portfolio_advice(scored, regs, I.targeted_by_regulation(regs, True)).select(
        "reg_id", "pos", "advice")


@query
def reco_reduce(x):
    a = assessed(x)
    rows = RC.reduce_rows(a.scored, a.regulations, a.facts)
    return rounded(rows.withColumn("suppliers_at_risk", joined("suppliers_at_risk")).drop("geographic_exposure"),
                   "risk_score", "estimated_loss_billions")


@query
def reco_hedge(x):
    return rounded(RC.hedge_rows(full(x)), "strike_pct", "cost_pct")


@query
def reco_rotation(x):
    # Base scores: blended ones rarely reach the rotation mark on these tables.
    rows = RC.rotation_rows(base(x)).drop("recommendation").withColumn("target_sectors", joined("target_sectors"))
    return rounded(rows, "sector_risk", "sector_weight", "trim_weight")


@query
def reco_rotation_blended(x):
    rows = RC.rotation_rows(full(x)).drop("recommendation").withColumn("target_sectors", joined("target_sectors"))
    return rounded(rows, "sector_risk", "sector_weight", "trim_weight")


@query
def reco_monitor(x):
    return RC.monitor_rows(full(x))


@query
def reco_override(x):
    a = assessed(x).staged()
    rules = RC.rule_recommendations(a.scored, a.regulations)
    rows = RC.override_rules(rules, x["recommendation_replies"])
    return rows.select("reg_id", "action", "position", "ticker", joined("tickers").alias("tickers"), "reason",
                       "timeline", "estimated_impact", "urgency")


@query
def reco_display(x):
    a = assessed(x).staged()
    rules = RC.rule_recommendations(a.scored, a.regulations, a.facts)
    rows = RC.display(RC.override_rules(rules, x["recommendation_replies"]))
    return rounded(rows, "risk_score", "estimated_loss_billions")


@query
def scenario_losses(x):
    return rounded(PF.scenario_losses(full(x)), "loss_trillions")


# ---------------------------------------------------------------- datasets

@query
def chart_risk_weight(x):
    return billions(rounded(D.risk_weight(stage(full(x))), "weight", "risk_score", "loss_pct", "mean_risk"), "market_cap")


@query
def chart_concentration(x):
    return rounded(D.concentration_chart(PF.theme_concentration(full(x))), "weight_exposure", "avg_risk_pct")


@query
def chart_top_risks(x):
    return rounded(D.top_risks_chart(full(x)), "risk_score")


@query
def chart_losses(x):
    return rounded(D.losses_chart(full(x)), "loss_billions", "loss_pct")


@query
def chart_components(x):
    return rounded(D.components_chart(full(x)), "value")


@query
def chart_geography(x):
    a = assessed(x)
    return D.geography_chart(a.scored, a.facts, 15)


@query
def chart_timeline(x):
    return D.timeline_chart(extracted(x))


# ---------------------------------------------------------------- report

def reply_themes(x) -> DataFrame:
    parsed = x["model_replies"].select(
        "reg_id", F.from_json(R.reply_record(F.col("reply"))["json"], "themes array<string>")["themes"].alias("given"))
    return stage(cleaned(x).join(parsed, "reg_id").select(
        "reg_id", RP.report_themes(F.col("given"), F.col("text")).alias("themes")))


def filing_passages(x) -> DataFrame:
    """Passages of the filings that snippets come from; others are not cut."""
    rows = P.passages(x["filings"].filter(RP.retrieved()), ["filing_id", "ticker", "filing_type", "fiscal_year", "title", "url"], 300, 100)
    return stage(P.identified(P.with_word_counts(rows), "filing_id"))


@query
def report_themes(x):
    return reply_themes(x).select("reg_id", joined("themes").alias("themes"))


@query
def attribute_filter(x):
    wanted = P.attribute_filter({"filing_type": "10-K", "fiscal_year": 1997, "ticker": None, "other": "x"})
    return x["every_filing"].filter(wanted).select("filing_id", "ticker", "filing_type", "fiscal_year")


@query
def filing_store(x):
    # Filings in folders and buckets, of which a year and a type are read.  There are no more filings than orders,
    # whose number the files' footers tell.
    path = scratch(x.spark)
    table = "filings_" + path.rsplit("-", 1)[1]
    filings = FS.write_filings(x["filings"], table, path, FS.buckets_for(x.table("orders").count()))
    wanted = filings.filter(P.attribute_filter({"filing_type": "10-K", "fiscal_year": 1997}))
    return wanted.select("filing_id", "ticker", "filing_type", "fiscal_year", F.length("text").cast("long").alias("n_chars"))


@query
def passage_topk(x):
    themes = unnest(reply_themes(x), "themes", "theme")
    return rounded(RP.theme_snippets(filing_passages(x), themes).drop("type"), "score")


def reg_snippets(x) -> DataFrame:
    wanted = unnest(reply_themes(x), "themes", "theme", "reg_id")
    return stage(wanted.join(RP.theme_snippets(filing_passages(x), wanted), "theme"))


@query
def exposed_companies(x):
    return rounded(RP.exposed_companies(reg_snippets(x), x["holdings"].select("company")), "total_score")


@query
def reply_json(x):
    return x["model_replies"].select("reg_id", F.inline(F.array(R.reply_record(F.col("reply")))))


@query
def exposure_report(x):
    exposed = RP.exposed_companies(reg_snippets(x), x["holdings"].select("company"))
    body = RP.exposure_report(x["report_requests"], exposed, PF.market_snapshot(portfolio(x)))
    read = F.from_json("body", "error string, companies array<struct<company: string>>, "
                               "market_data struct<count: bigint>")
    return body.select("reg_id", "status_code", read.alias("b")).select(
        "reg_id", "status_code", F.col("b.error").alias("error"),
        joined(F.transform("b.companies", lambda c: c["company"])).alias("companies"),
        F.col("b.market_data.count").alias("n_holdings"))
