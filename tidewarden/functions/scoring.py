"""Risk rules as column arithmetic."""

from pyspark.sql import Column, functions as F

from .. import config as C


def capped(c: Column, cap) -> Column:
    return F.least(c, cap if isinstance(cap, Column) else F.lit(cap))


def flag(condition: Column, value) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.when(condition, value).otherwise(F.lit(0.0))


def measure_intensity(n_measures: Column, scale: Column, cap: Column) -> Column:
    return F.least(scale * n_measures, cap)


def base_risk(x: dict[str, Column]) -> Column:
    """Mention of symbol or name counts once."""
    return capped(F.lit(C.BASELINE_RISK) + x["intensity"]
                  + flag(x["symbol_hit"] | x["company_hit"], x["mention_boost"])
                  + flag(x["theme_hit"], x["theme_boost"])
                  + x["penalty"] + x["compliance"], 1.0)


def direct_risk(x: dict[str, Column]) -> Column:
    """Symbol and name mentions add up; the full name weighs 1.2 times."""
    return capped(F.lit(C.BASELINE_RISK) + x["intensity"]
                  + flag(x["symbol_hit"], x["mention_boost"])
                  + flag(x["company_hit"], x["mention_boost"] * C.COMPANY_MENTION_FACTOR)
                  + flag(x["theme_hit"], x["theme_boost"])
                  + x["penalty"] + x["compliance"], 1.0)


def supply_risk(supplier_hits: Column, geo_pairs: Column) -> Column:
    return capped(C.SUPPLIER_HIT_RISK * supplier_hits + C.SUPPLIER_GEO_RISK * geo_pairs, C.SUPPLY_CAP)


def geographic_risk(exposure: Column, hit_regions: Column) -> Column:
    """Half of the exposed share over the regions that a regulation names."""
    total = F.reduce(
        exposure, F.lit(0.0),
        lambda acc, e: acc + F.when(F.array_contains(hit_regions, e["region"]),
                                    e["share"] / 100 * C.REGION_RISK).otherwise(F.lit(0.0)))
    return capped(F.coalesce(total, F.lit(0.0)), C.GEOGRAPHIC_CAP)


def finding_risk(direct: Column, suppliers: Column, geographic: Column) -> Column:
    return (direct + suppliers + geographic) / 300.0


def blended_risk(direct: Column, supply: Column, geographic: Column, finding: Column) -> Column:
    """Weighted blend; without a finding score its weight goes to the others."""
    def mix(w):
        return (direct * w["direct"] + supply * w["supply"]
                + geographic * w["geographic"] + finding * w["finding"])
    return capped(F.when(finding == 0, mix(C.BLEND_RULES_ONLY)).otherwise(mix(C.BLEND_WITH_FINDING)), 1.0)


def loss_pct(risk: Column, multiplier: Column, cap: Column) -> Column:
    return F.least(risk * multiplier, cap)


def loss_amount(market_cap: Column, pct: Column) -> Column:
    return F.coalesce(market_cap, F.lit(0.0)) * (pct / 100.0)


def fired(*pairs: tuple[Column, Column], default: str) -> Column:
    """Join the labels of the rules that fired, or give the default label."""
    hits = F.array_compact(F.array(*[F.when(cond, label) for cond, label in pairs]))
    return F.when(F.size(hits) > 0, F.array_join(hits, ", ")).otherwise(F.lit(default))


def template(text: str, value: Column) -> Column:
    """Fill the single slot of a label."""
    head, tail = text.split("{}")
    return F.concat(F.lit(head), value, F.lit(tail))


def base_drivers(x: dict[str, Column]) -> Column:
    return fired(
        (x["symbol_hit"] | x["company_hit"], F.lit(C.DRIVER_MENTION)),
        (x["theme_hit"], template(C.DRIVER_THEME, x["theme"])),
        (x["penalty"] != 0, F.lit(C.DRIVER_PENALTY)),
        (x["compliance"] != 0, F.lit(C.DRIVER_COMPLIANCE)),
        default=C.DRIVER_DEFAULT)


def full_drivers(direct: Column, supply: Column, geographic: Column,
                 n_suppliers: Column, exposure: Column) -> Column:
    regions = F.array_join(F.slice(F.transform(exposure, lambda e: e["region"]), 1, 3), ", ")
    return fired(
        (direct > 0.3, F.lit(C.DRIVER_DIRECT)),
        (supply > 0.2, template(C.DRIVER_SUPPLY, n_suppliers.cast("string"))),
        (geographic > 0.2, template(C.DRIVER_GEOGRAPHIC, regions)),
        default=C.DRIVER_DEFAULT)


def risk_band(risk: Column) -> Column:
    return (F.when(risk > C.HIGH_RISK, F.lit("high"))
            .when(risk > C.MEDIUM_RISK, F.lit("medium"))
            .when(risk > 0, F.lit("low")).otherwise(F.lit("none")))


def risk_tier(risk: Column) -> Column:
    return (F.when(risk > C.TIER_CRITICAL, F.lit("critical"))
            .when(risk > C.TIER_ELEVATED, F.lit("elevated")).otherwise(F.lit("moderate")))
