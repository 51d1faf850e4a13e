import json
from datetime import datetime

import pytest

SCHEMAS = {
    "source_documents": "file_id bigint, repo string, revision string, relative_path string, content binary, captured_at timestamp_ntz, received_at timestamp_ntz, language string, reason string, hash string",
    "header_languages": "path string, profile string, language string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, repo string, created_at timestamp_ntz, item_id bigint, ids string",
    "benchmark": "item_id bigint, text string, lang string, suite string, doc_id bigint",
    "license_catalog": "license_id string, title string, edition string, body string, repo string",
    "reading_labels": "doc_id bigint, rater string, reading_level int, text string",
}
CATALOGUE = [
    ("AAA-1.0", "Alder Public License", "1.0", "Everybody may copy this work in any shape they like. Nobody answers for what breaks.", "x"),
    ("BBB-2.0", "Birch Terms", "2.0", "Copies stay under these very same terms for ever and ever. No promise is made by anyone.", "x"),
    ("BBB-3.0", "Birch Terms", "3.0", "Copies stay under these very same terms also over a wire. Patents are licensed along with the work. No promise is made by anyone at all.", "x"),
]


@pytest.fixture
def tables(spark, tmp_path):
    """Write small tables, columns that clash included; what is not given is empty but for the licence catalogue."""

    def write(**given):
        for name, schema in SCHEMAS.items():
            rows = given.get(name, CATALOGUE if name == "license_catalog" else [])
            width = schema.count(",") + 1
            spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def sources(files, start=1):
    """Deliveries of ``{path: text or bytes or None}``, ids in order, the first file delivered twice."""
    at = datetime(2025, 1, 1)
    rows = [(k, p.split("/")[0], "r", p, None if c is None else bytearray(c if isinstance(c, bytes) else c.encode()), at, at) for k, (p, c) in enumerate(files.items(), start)]
    return rows + rows[:1]


@pytest.fixture
def source_rows():
    return sources


__all__ = ["json"]
