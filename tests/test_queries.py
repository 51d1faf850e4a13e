import glob
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def _registered():
    from factloom.operators import heavy_keys
    from factloom.plans import queries

    return heavy_keys.QUERIES | queries.QUERIES, heavy_keys.ORACLE | queries.ORACLE


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(_registered()[1]))
def test_against_sql(spark, name):
    queries, oracle = _registered()
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = queries[name](spark, DATA)
    stated = con.execute(oracle[name])
    columns = [c[0] for c in stated.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = sorted((tuple(map(_plain, r)) for r in stated.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in frame.collect()), key=repr) == expected


def test_heavy_keys_edges(spark, tmp_path):
    from factloom.operators import heavy_keys

    schema = "finding_id bigint, rule string, path string, reported_at timestamp_ntz, extra int, findings int"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/findings.parquet"))
    assert heavy_keys.heavy_keys(spark, str(tmp_path / "none")).count() == 0
    from datetime import datetime as d

    rows = [(k, "hot" if k % 3 else None, "./a\\b" if k % 2 else "a/b", d(2025, 1, 1, 0, 0, k % 60) if k % 7 else None, 1, 2) for k in range(300)] + [(5, "hot", "a/b", None, 1, 2), (None, "x", "y", None, 1, 2)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "some/findings.parquet"))
    assert {tuple(r) for r in heavy_keys.heavy_keys(spark, str(tmp_path / "some")).collect()} == {("rule", "hot"), ("path", "a/b")}
    gaps = {(r.key_field, r.key_text): (r.findings, r.longest_gap_us) for r in heavy_keys.key_gaps(spark, str(tmp_path / "some")).collect()}
    assert gaps["path", "a/b"] == (300, 1_000_000)
