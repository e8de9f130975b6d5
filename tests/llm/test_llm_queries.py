import pytest

from folioflow.llm import queries
from tests import compare

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p2_found": {"item_kind", "item_key", "item_pos"}, "p3_found": {"block_key", "defect"}, "p4_found": {"block_key"}, "p5_found": {"key_a", "key_b"}, "p6_ids": {"doc_id", "ids"}, "p8_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert set(df.columns) == COLUMNS.get(name, set(df.columns))
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert compare.difference(queries.QUERIES[name](spark, SF), compare.connect(SF), queries.ORACLES[name]) == ""
