"""Every query of the subpackage on the smallest tables."""

import pytest

from patrika.llm.queries import QUERIES

COLUMNS = {
    "p1_found": ["raw_item_id", "line_no"], "p2_found": ["job_id", "field_name", "candidate_id"], "p3_found": ["field_name", "name_a", "name_b"], "p4_found": ["field_name", "id_a", "id_b"],
    "p6_found": ["field_name", "record_id", "line_no", "defect"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert name not in COLUMNS or frame.columns == COLUMNS[name]
    rows = frame.collect()
    assert name not in COLUMNS or len(set(rows)) == len(rows)
