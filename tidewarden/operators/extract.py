"""Extraction record per regulation document."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import lexicon as L, overrides as O, replies as R, text as T
from .ranges import running_total
from .rows import struct_rows, unnest, unnest_fields


def clean_documents(docs: DataFrame) -> DataFrame:
    """Split the inline configuration off and clean each text by its extension.

    Input: ext, text and any key columns.  Adds ``cfg``; ``text`` becomes the
    cleaned text.  Documents are read once; only the bodies of XML documents
    are handed to the Arrow-batched parser, all others pass it as nulls.

    Deviation: every document is cleaned by its own extension, and all later
    rules read the cleaned text.
    """
    split = docs.withColumns({
        "cfg": O.parse_config(O.config_json(F.col("text"))),
        "text": O.without_config(F.coalesce("text", F.lit(""))),
    })
    is_xml = F.coalesce(F.lower("ext") == "xml", F.lit(False))
    return split.withColumn("text", F.when(is_xml, T.xml_text(F.when(is_xml, F.col("text")))).otherwise(
        T.clean_text(F.col("text"), F.col("ext"))))


def extract(docs: DataFrame, *, fold_case: bool = False, whole_word_years: bool = False,
            gazetteer=None, entity_words=None, measure_terms=None) -> DataFrame:
    """Adds entities, dates, measures and type_reg to cleaned documents.

    Stateless and free of shuffles: it runs the same on a stream.
    """
    text = F.col("text")
    masked = docs.withColumns({
        "_masked": T.mask_citations(text), "_lower": F.lower(text),
        "_exact": L.measure_phrases(text, measure_terms, fold_case)})
    dated = L.gazetteer_matches(text, [C.DATE_LABEL], gazetteer)
    return masked.withColumns({
        "entities": L.entities(text, gazetteer, entity_words),
        "dates": F.sort_array(F.array_union(
            F.array_union(T.strong_dates(F.col("_masked")),
                          T.context_years(F.col("_masked"), whole_word_years)), dated)),
        "measures": F.sort_array(L.or_fallback(F.col("_exact"), text, fold_case)),
        "measures_exact": F.size("_exact") > 0,
        "type_reg": L.regulation_type(F.col("_lower")),
        "penalty_hit": T.contains_any(F.col("_lower"), C.PENALTY_WORDS),
        "compliance_hit": T.contains_any(F.col("_lower"), C.COMPLIANCE_WORDS),
    }).drop("_masked", "_lower", "_exact")


def extract_documents(docs: DataFrame, **options) -> DataFrame:
    return extract(clean_documents(docs), **options)


def merge_findings(extracted: DataFrame, findings: DataFrame) -> DataFrame:
    """Merge supplied findings (reg_id, finding JSON, error) into the extraction.

    The supplied type replaces ours; entities, dates and measures are united.
    A finding that does not parse counts as the unavailable record.  Documents
    without a finding keep their extraction and get no severity.
    """
    joined = extracted.join(
        findings.select("reg_id", F.lit(True).alias("_given"), F.col("finding").alias("_json"),
                        F.col("error").alias("_error")), "reg_id", "left")
    joined = joined.withColumn("_f", R.regulation_finding(F.col("_json")))

    def given(new: Column, old: Column) -> Column:
        return F.when(F.col("_given"), new).otherwise(old)

    def united(name: str, extra: str) -> Column:
        return given(F.sort_array(F.array_union(name, F.col(extra))), F.col(name))

    return joined.withColumns({
        "type_reg": given(F.coalesce("_f.type_regulation", "type_reg"), F.col("type_reg")),
        "entities": united("entities", "_f.companies"),
        "dates": united("dates", "_f.dates"),
        "measures": united("measures", "_f.measures"),
        "severity": F.when(F.col("_given"), F.col("_f.severity")),
        "summary": F.when(F.col("_given"), F.col("_f.summary")),
        "finding_status": F.struct(
            (F.coalesce("_given", F.lit(False)) & F.col("_error").isNull()).alias("enabled"),
            F.col("_error").alias("error")),
    }).drop("_given", "_json", "_error", "_f")


def digest(extracted: DataFrame, n_entities: int = 15, n_dates: int = 10) -> DataFrame:
    """Counts per document and its first entities and dates, as many as asked."""
    return extracted.select(
        "reg_id", "name", "type_reg",
        F.size("entities").alias("n_entities"), F.size("dates").alias("n_dates"),
        F.size("measures").alias("n_measures"),
        F.slice("entities", 1, n_entities).alias("top_entities"),
        F.slice("dates", 1, n_dates).alias("top_dates"))


def measure_frequency(extracted: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` measures that occur in most documents.

    Deviation: occurrences are counted over documents; within one document the
    list is already distinct.
    """
    return (unnest(extracted, "measures", "measure")
            .groupBy("measure").agg(F.count("*").alias("occurrences"))
            .orderBy(F.col("occurrences").desc(), "measure").limit(n))


def corpus_offsets(docs: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Position of every document inside the blank-joined text of its group; all columns but the text.

    The combined text is described, not built, and no text is moved: a group may hold any
    number of documents.  ``order`` should name each document of a group; those alike in
    it go by their lengths.  A null text counts as an empty one.
    """
    sized = docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint")).drop("text")
    placed = running_total(sized.withColumn("_span", F.col("n_chars") + 1), [group], order, "_span", "start_pos")
    return placed.drop("_span")


def combine(extracted: DataFrame, group: str) -> DataFrame:
    """One extraction record per group of documents, as if their texts were joined.

    One pass: every document gives tagged values, duplicates go in a partial
    aggregation, and what is left to collect are dictionary words and dates,
    never texts.  The type is decided again in dictionary order, and loose
    measures count only where no member has an exact one.
    """
    order = list(C.REG_TYPE_KEYWORDS) + [C.OTHER]
    position = F.array_position(F.array(*map(F.lit, order)), F.col("type_reg"))
    tags = F.concat(
        struct_rows(F.col("entities"), "entity"), struct_rows(F.col("dates"), "date"),
        F.when(F.col("measures_exact"), struct_rows(F.col("measures"), "exact"))
        .otherwise(struct_rows(F.col("measures"), "loose")),
        struct_rows(F.array(F.concat(F.lpad(position.cast("string"), 3, "0"), "type_reg")), "type"),
        struct_rows(F.array_compact(F.array(
            F.lit("doc"), F.when(F.col("penalty_hit"), F.lit("penalty")),
            F.when(F.col("compliance_hit"), F.lit("compliance")))), "flag"))
    values = (unnest_fields(extracted, tags, "kind", group)
              .groupBy(group, "kind", "v").agg(F.count("*").alias("n")))

    def of(kind):
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("v"))))

    def flagged(name):
        return F.max(F.when((F.col("kind") == "flag") & (F.col("v") == name), F.col("n")))

    found = values.groupBy(group).agg(
        of("entity").alias("entities"), of("date").alias("dates"), of("exact").alias("_exact"),
        of("loose").alias("_loose"), F.min(F.when(F.col("kind") == "type", F.col("v"))).alias("_type"),
        flagged("penalty").isNotNull().alias("penalty_hit"),
        flagged("compliance").isNotNull().alias("compliance_hit"), flagged("doc").alias("n_docs"))
    return found.select(
        group, F.substring("_type", F.lit(4), F.length("_type")).alias("type_reg"), "penalty_hit",
        "compliance_hit", "n_docs", "entities", "dates",
        F.when(F.size("_exact") > 0, F.col("_exact")).otherwise(F.col("_loose")).alias("measures"))
