"""All catalogs of the core library."""

from __future__ import annotations

from sparline.plans import audit_queries, composed_queries, engine_queries, inference_queries, lineage_queries, perturbation_queries, problem_queries, profile_queries, ranking_queries, report_queries, text_queries
from sparline.plans.catalog import Catalog


def catalogs() -> list[Catalog]:
    return [problem_queries.CATALOG, ranking_queries.CATALOG, inference_queries.CATALOG, text_queries.CATALOG, audit_queries.CATALOG, composed_queries.CATALOG, perturbation_queries.CATALOG, lineage_queries.CATALOG, report_queries.CATALOG, engine_queries.CATALOG, profile_queries.CATALOG]
