"""Queries of the operators over whole tables, and their SQL where SQL can say it."""

from tidewarden.llm import (first_fit_packing, lanczos_whitening, language_spans, lattice_dedup, license_scan, packing,
                            pivotal_spelling, quality_ledger, quality_perplexity, secret_scan, simhash_dedup,
                            source_mixing, url_filter)

QUERIES = {
    "op1_embedding_near_dedup": lattice_dedup.query,
    "op2_secret_scans": secret_scan.query,
    "op3_simhash_near_dedup": simhash_dedup.query,
    "op4_best_fit_packing": packing.query,
    "op5_license_scans": license_scan.query,
    "op6_url_filters": url_filter.query,
    "op7_language_id": language_spans.query,
    "op8_quality_rules": quality_ledger.query,
    "quality_ablation": quality_ledger.ablation_query,
    "op9_mixing_sources": source_mixing.query,
    "op10_quality_classifier": quality_perplexity.query,
    "op11_embedding_whitening": lanczos_whitening.query,
    "op12_spelling_variants": pivotal_spelling.query,
    "op13_first_fit_packing": first_fit_packing.query,
}
SQL = {
    "op5_license_scans": license_scan.oracle(),
    "op6_url_filters": url_filter.oracle(),
    "op8_quality_rules": quality_ledger.oracle(),
    "quality_ablation": quality_ledger.ablation_oracle(),
    "op9_mixing_sources": source_mixing.oracle(),
}
