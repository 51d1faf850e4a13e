import duckdb
import pytest

from factloom.plans import contract_cases
from factloom.sources.authority import Rejection, from_documents


@pytest.mark.parametrize("name", sorted(contract_cases.QUERIES))
def test_stated_rows(spark, name):
    frame = contract_cases.QUERIES[name](spark, "")
    expected = duckdb.sql(contract_cases.ORACLE[name])
    assert frame.columns == expected.columns
    assert sorted(map(tuple, frame.collect())) == sorted(expected.fetchall())


def test_facts_from_documents():
    """Exactly one document named authority.json is admitted."""
    raw = b'{"schema_version": 4, "token_vocabulary": ["value"]}'
    assert from_documents({"authority.json": raw}).token_vocabulary == ("value",)
    for documents in ({}, {"other.json": raw}, {"authority.json": raw, "other.json": raw}):
        with pytest.raises(Rejection):
            from_documents(documents)


def test_snapshot_digest_and_partial_parameters(spark):
    import json

    from factloom.plans import review
    from factloom.sources.authority import admit

    facts = admit(json.dumps({"schema_version": 4, "token_vocabulary": ["calculate", "velocity", "value"], "public_callables": {"a.cpp": ["calculate_velocity"]}}))
    documents = spark.createDataFrame([("a.cpp", bytearray("/** 计算速度 */\nint calculate_velocity(int, int value);\n".encode())), ("b.rs", bytearray(b"use $first;\n"))], "relative_path string, content binary")
    result = review.review(documents, facts, "r")
    sealed = json.loads(review.canonical(result))
    assert list(sealed)[-3:] == ["semantic_authority_digest", "snapshot_digest", "seal"] and len(sealed["snapshot_digest"]) == 64
    again = review.review(documents.repartition(3), facts, "r")
    assert review.canonical(again) == review.canonical(result)
    reasons = {(r.path, r.family): r.reason for r in result.coverage.filter("state = 'blocked'").collect()}
    assert reasons["a.cpp", "documentation"] == "unresolved callable documentation facts: calculate_velocity@2:5[parameters]"
    assert reasons["b.rs", "dependency_declaration"] == "use tree is unsupported at 1:1: $first"
