"""Runnable queries over the Parquet tables, one module per operator group."""

from __future__ import annotations

import importlib

from docmarket.registry import REGISTRY, Registered

MODULES = (
    "text", "listings", "structure", "terms", "market", "quality", "gaps", "roles", "guards", "alignment", "requirements", "reports", "analysis", "refresh",
)

# Counts and positions that Spark gives as INT and the SQL twin as BIGINT; shown as BIGINT.
WIDE = {
    "B16_count_markers": None, "B19_audit_urls": None, "B21_profile_links": None, "A5_lookup_live": None, "A6_lookup_live_any_location": None, "I4_merge_ranked": ("rank", "position"),
    "I7_overlap_join": None, "I9_run_history": None, "C1_explode_lines": None, "C2_detect_headers": None, "C7_line_signals": None, "C10_chronology_signals": None, "E2_match_terms": None,
    "K2_prune_demand": None, "K2_prune_demand_documents": None, "M9_text_evidence": None, "M2_cosine_topk": None, "J1_rank_candidates": None, "J2_cap_per_company": None,
    "J5_top_matches_reserved": None, "J7_weakest_components": None, "J9_cap_per_group": None, "G11_context_signals": None, "J10_rank_per_source": None, "E15_title_fallback_profile": None,
    "N1_recommendations": None, "L4_augment_gaps": None, "L7_bucket_gap_report": None,
    "G6_title_overlaps": ("title_overlap", "family_overlap", "core_title", "core_text", "specialty_overlap", "precision"),
}


def _widened(run, columns):
    def wide(spark, folder):
        df = run(spark, folder)
        names = columns or [c for c, kind in df.dtypes if kind == "int"]
        return df.withColumns({c: df[c].cast("bigint") for c in names}) if names else df

    return wide


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    for name, columns in WIDE.items():
        item = REGISTRY[name]
        if not getattr(item.run, "is_wide", False):
            run = _widened(item.run, columns)
            run.is_wide = True
            REGISTRY[name] = Registered(name, run, item.sql)
