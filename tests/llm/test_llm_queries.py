"""Every query of the subpackage over the smallest tables, and p1 against its SQL."""

import pytest
from conftest import same_as_sql

from tallyrill.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": ["session_id", "first_line", "last_line"], "p2_found": ["record_kind", "record_id", "field", "item"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "level"],
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in SQL:
        same_as_sql(df, SQL[name], data)
    else:
        df.collect()
