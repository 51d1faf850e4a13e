"""Rows that are null in every column, beside one ordinary file and document, crash nothing and add nothing."""

import pytest

from factloom.llm.queries import QUERIES

#: Rows of each query for the one file and the one document alone.
EXPECTED = {"p1_found": 0, "p1_rates": 1, "p1_reasons": 0, "p3_found": 1, "p3_shares": 1, "p4_found": 0, "p5_found": 1, "p5_pairs": 1, "p6_found": 2, "p7_found": 0, "p9_found": 0}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_null_rows(spark, tables, source_rows, name):
    nulls = [(None,)]
    directory = tables(
        source_documents=source_rows({"a/x.py": 'def f():\n    """Gives the number of all parts."""\n    return 1\n'}) + [(None,), (7,), (None, "a", None, "a/y.py", bytearray(b"("))],
        documents=[(1, "one text")] + nulls, benchmark=nulls, reading_labels=nulls + [(1, None, None)], header_languages=nulls + [("a/z.h", None)], license_catalog=nulls + [("X-1", None, None, None)],
    )
    rows = QUERIES[name](spark, directory).collect()
    assert len(rows) == EXPECTED.get(name, len(rows))
