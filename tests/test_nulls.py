"""Every core query over empty tables, and over tables with a row of nulls and columns whose names clash with computed ones."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from factloom.operators import heavy_keys
from factloom.plans import queries

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in heavy_keys.QUERIES | queries.QUERIES if not n.startswith("review_"))


@pytest.fixture(scope="module")
def directories(tmp_path_factory):
    if not os.path.isdir(DATA):
        pytest.skip("test tables are absent")
    empty, nulls = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("nulls")
    for name in os.listdir(DATA):
        table = pq.read_table(f"{DATA}/{name}").slice(0, 3)
        pq.write_table(table.slice(0, 0), empty / name)
        row = pa.Table.from_pylist([dict.fromkeys(table.schema.names)], schema=pa.schema([f.with_nullable(True) for f in table.schema]))
        both = pa.concat_tables([table.cast(row.schema), row, table.slice(0, 1).cast(row.schema)])
        for extra in ("language", "family_ordinal", "token", "digest", "salt", "total"):
            if extra not in both.schema.names:
                both = both.append_column(extra, pa.array(["x"] * both.num_rows))
        pq.write_table(both, nulls / name)
    return str(empty), str(nulls)


@pytest.mark.parametrize("name", NAMES)
def test_edges(spark, directories, name):
    query = (heavy_keys.QUERIES | queries.QUERIES)[name]
    single = {"finding_summary"}
    assert query(spark, directories[0]).count() == (1 if name in single else 0)
    query(spark, directories[1]).collect()
