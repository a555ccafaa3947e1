import pytest

from reportmill.llm import queries
from tests.compare import connect, rows

COLUMNS = {
    "p3_found": {"row_id", "place_id"}, "p4_found": {"source_id_a", "source_id_b"}, "p5_found": {"cluster_key", "source_id"}, "p6_found": {"source_id_a", "source_id_b"},
    "p7_found": {"doc_id", "item_id"}, "p9_found": {"doc_id"},
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert len(got) and got.columns.is_unique
    if name in COLUMNS:
        assert set(got.columns) == COLUMNS[name] and not got.duplicated().any()
    if name in queries.SQL:
        assert rows(got) == rows(connect(folder).execute(queries.SQL[name]).fetchdf())
