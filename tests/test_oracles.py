from __future__ import annotations

import pytest

from tests.oracle import DATA, compare

NAMES = (
    "p1_found", "p1_project_profile", "p5_found", "p5_orphan_report", "e03_localization", "e12_budget_prefix", "d08_enrichment", "c14_paired_differences",
    "i01_signed_rank", "i22_ranking_metrics", "f05_best_threshold", "e18_rehearsal_cohort", "h01_normal_forms", "c04_match_by_count", "k06_spans", "c11_token_owners", "g02_set_equivalence",
    "audit_p23_grouping_sets", "s01_stream_hours", "b07_label_status", "b12_conflict_classes", "audit_p21_anchors", "k20_without_positives", "l16_occlusion", "n01_resumed_run", "i16_pairwise_statistics",
    "i19_one_sample_report", "d31_truncation_by_split", "k15_text_digests", "q07_group_balance", "c22_upsert_sizes", "h42_signed_minus_absolute", "d20_group_comparison", "f06_ordered_units",
)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    from sparline.plans.registry import catalogs

    found = {k: (c.queries[k], c.oracles[k]) for c in catalogs() for k in c.oracles}
    compare(spark, *found[name])
