"""Structured results supplied by an external model, parsed defensively."""

from pyspark.sql import Column, functions as F

from .. import config as C

REGULATION_FINDING = (
    "struct<type_regulation: string, secteurs_impactes: array<string>, "
    "entreprises_a_risque: array<string>, dates_cles: array<string>, mesures: array<string>, "
    "implications_indirectes: struct<chaine_approvisionnement: string, geographique: string>, "
    "severite: int, resume: string>")
COMPANY_FINDING = (
    "struct<impact_direct: double, impact_fournisseurs: double, impact_geographique: double, "
    "fournisseurs_a_risque: array<string>, regions_a_risque: array<string>, "
    "recommandation: string, justification: string, score_risque_global: double>")
SUPPLY_FINDING = (
    "struct<risk_level: string, risk_score: int, affected_suppliers: array<string>, "
    "geographic_risks: map<string,string>, mitigation_strategies: array<string>>")
RECOMMENDATION = (
    "struct<action: string, tickers_concernes: array<string>, justification: string, "
    "timeline: string, impact_estime: string, urgence: string>")


def is_json(c: Column) -> Column:
    """True for one well-formed JSON object or array and nothing after it.

    The parser stops after the first value, so the text is tested inside an
    array and inside an object: only a complete single value fits both.
    """
    in_list = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))).isNotNull()
    return F.coalesce(F.ltrim(c).rlike(r"^[\[{]") & in_list & in_object, F.lit(False))


def _reply_body(reply: Column) -> Column:
    fenced = F.regexp_extract(reply, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(reply)


def json_object(reply: Column) -> Column:
    """The JSON object inside a model reply, null when none parses.

    A fenced block is preferred; then an object that runs to the end of the
    text; then everything from the first brace to the last.
    """
    body = _reply_body(reply)
    tail = F.regexp_extract(body, r"(?s)\{.*\}\s*$", 0)
    raw = F.when(tail != "", tail).otherwise(body)
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.coalesce(F.when(is_json(raw), raw), F.when(is_json(braces), braces))


def reply_record(reply: Column) -> Column:
    """(json, raw_response, error): an empty reply is an empty object, not an error."""
    found = json_object(reply)
    empty = reply.isNull() | (reply == "")
    failed = found.isNull() & ~empty
    return F.struct(
        F.when(empty, F.lit("{}")).otherwise(found).alias("json"),
        F.when(failed, _reply_body(reply)).alias("raw_response"),
        F.when(failed, F.lit("json_parse_failed")).alias("error"))


def _text(value: str) -> Column:
    return F.lit(value)


def _names(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def regulation_finding(c: Column) -> Column:
    """Finding on a regulation; the unavailable record when missing or invalid."""
    parsed = F.from_json(c, REGULATION_FINDING)
    bad = c.isNull() | ~is_json(c)
    indirect = parsed["implications_indirectes"]
    return F.struct(
        F.when(bad, _text(C.FINDING_UNKNOWN_TYPE)).otherwise(parsed["type_regulation"]).alias("type_regulation"),
        _names(parsed["secteurs_impactes"]).alias("sectors"),
        _names(parsed["entreprises_a_risque"]).alias("companies"),
        _names(parsed["dates_cles"]).alias("dates"),
        _names(parsed["mesures"]).alias("measures"),
        F.coalesce(indirect["chaine_approvisionnement"], _text(C.FINDING_UNAVAILABLE)).alias("supply_effect"),
        F.coalesce(indirect["geographique"], _text(C.FINDING_UNAVAILABLE)).alias("geographic_effect"),
        F.when(bad, F.lit(0)).otherwise(F.coalesce(parsed["severite"], F.lit(5))).alias("severity"),
        F.when(bad, _text(C.FINDING_NO_SUMMARY)).otherwise(
            F.coalesce(parsed["resume"], _text(""))).alias("summary"))


def company_finding(c: Column) -> Column:
    """Finding on one company; zeros and HOLD when missing or invalid."""
    parsed = F.from_json(c, COMPANY_FINDING)

    def score(name):
        return F.coalesce(parsed[name], F.lit(0.0))

    return F.struct(
        score("impact_direct").alias("impact_direct"),
        score("impact_fournisseurs").alias("impact_suppliers"),
        score("impact_geographique").alias("impact_geographic"),
        _names(parsed["fournisseurs_a_risque"]).alias("suppliers_at_risk"),
        _names(parsed["regions_a_risque"]).alias("regions_at_risk"),
        F.coalesce(parsed["recommandation"], _text(C.FINDING_HOLD)).alias("action"),
        F.coalesce(parsed["justification"], _text(C.FINDING_UNAVAILABLE)).alias("reason"),
        score("score_risque_global").alias("overall"))


def supply_finding(c: Column) -> Column:
    """Supply-chain finding; an unknown level when missing or invalid."""
    parsed = F.from_json(c, SUPPLY_FINDING)
    return F.struct(
        F.coalesce(parsed["risk_level"], F.lit("unknown")).alias("risk_level"),
        parsed["risk_score"].alias("risk_score"),
        _names(parsed["affected_suppliers"]).alias("affected_suppliers"),
        parsed["geographic_risks"].alias("geographic_risks"))


def recommendation_list(c: Column) -> Column:
    """Supplied recommendations; one object counts as a list of one."""
    many = F.from_json(c, f"array<{RECOMMENDATION}>")
    one = F.array(F.from_json(c, RECOMMENDATION))
    return F.when(is_json(c), F.when(F.ltrim(c).startswith("["), many).otherwise(one))
