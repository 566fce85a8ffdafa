from __future__ import annotations

import pytest

from tests.oracle import DATA, compare


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["p2_found", "p2_top_regions", "p3_found", "p3_overlap_counts", "p3_links", "p4_found", "p4_piece_checks", "p6_found", "p6_container_checks", "p7_found", "p7_share_checks"])
def test_query_equals_its_sql(spark, name):
    from sparline.llm.queries import CATALOG

    compare(spark, CATALOG.queries[name], CATALOG.oracles[name])
