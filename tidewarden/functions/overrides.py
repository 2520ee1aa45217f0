"""Per-document configuration carried inside a regulation text."""

from pyspark.sql import Column, functions as F

from .. import config as C
from .lexicon import theme_rules, type_targets

CONFIG_SCHEMA = ("struct<params: map<string,string>, company_theme_keywords: map<string,string>, "
                 "text_theme_keywords: map<string,string>, reg_type_targets: map<string,string>>")


def config_json(raw: Column) -> Column:
    """The configuration block of a text, null when there is none."""
    block = F.regexp_extract(raw, f"(?s){C.CONFIG_BLOCK}", 1)
    return F.when(raw.rlike(f"(?s){C.CONFIG_BLOCK}"), block)


def without_config(raw: Column) -> Column:
    """The text with its first configuration block removed."""
    return F.regexp_replace(raw, rf"(?s)\A(.*?){C.CONFIG_BLOCK}", "$1")


def parse_config(block: Column) -> Column:
    """Configuration as a struct of raw maps; bad JSON gives empty overrides."""
    return F.from_json(block, CONFIG_SCHEMA)


def param(cfg: Column, name: str, default: float | None = None) -> Column:
    """Overridden parameter, or its default."""
    fallback = C.DEFAULT_PARAMS[name] if default is None else default
    return F.coalesce(F.try_element_at(cfg["params"], F.lit(name)).try_cast("double"), F.lit(fallback))


def word_list(raw: Column) -> Column:
    """A JSON list of words, or one bare word, as an array; null stays null."""
    return (F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))
            .when(raw.isNotNull(), F.array(raw)))


def company_rules(cfg: Column) -> Column:
    """Company-theme dictionary after overrides: array of (theme, words).

    An overridden theme keeps its place in the order; new themes come last.
    """
    own = cfg["company_theme_keywords"]
    names = F.array(*map(F.lit, C.COMPANY_THEME_KEYWORDS))
    defaults = F.array(*[
        F.struct(F.lit(t).alias("theme"), F.array(*map(F.lit, w)).alias("words"))
        for t, w in C.COMPANY_THEME_KEYWORDS.items()])
    replaced = F.transform(defaults, lambda d: F.struct(
        d["theme"].alias("theme"),
        F.coalesce(word_list(F.try_element_at(own, d["theme"])), d["words"]).alias("words")))
    added = F.transform(
        F.filter(F.map_keys(own), lambda k: ~F.array_contains(names, k)),
        lambda k: F.struct(k.alias("theme"), word_list(F.try_element_at(own, k)).alias("words")))
    return F.when(own.isNull(), defaults).otherwise(F.concat(replaced, added))


def company_theme_by(company: Column, rules: Column) -> Column:
    """Theme of a company under a document's own dictionary."""
    def hit(rule):
        pattern = F.concat(
            F.lit(r"(?U)\b(?:"),
            F.array_join(F.transform(rule["words"], lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|"),
            F.lit(r")s?\b"))
        return (F.size(rule["words"]) > 0) & F.rlike(F.lower(company), pattern)

    return F.coalesce(F.get(F.filter(rules, hit), F.lit(0))["theme"], F.lit(C.OTHER))


def text_rules(cfg: Column) -> Column:
    """Text-theme dictionary after overrides; a repeated keyword takes the new theme."""
    own = cfg["text_theme_keywords"]
    added = F.flatten(F.transform(F.map_entries(own), lambda e: F.transform(
        word_list(e["value"]),
        lambda w: F.struct(F.lower(w).alias("keyword"), e["key"].alias("theme")))))
    kept = F.filter(theme_rules(), lambda r: ~F.exists(added, lambda a: a["keyword"] == r["keyword"]))
    return F.when(own.isNull(), theme_rules()).otherwise(F.concat(kept, added))


def targets_by(cfg: Column, reg_type: Column) -> Column:
    """Themes targeted by a type after overrides."""
    own = word_list(F.try_element_at(cfg["reg_type_targets"], reg_type))
    return F.coalesce(own, type_targets(reg_type))
