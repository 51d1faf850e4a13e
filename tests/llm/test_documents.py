"""Operators over documents against reference encoders, brute force and held-out accuracy."""

import random
import re

import pytest

from factloom.llm import encoding, leakage, reading


@pytest.mark.parametrize("query", (encoding.ids, leakage.found, leakage.leaks, reading.levels))
def test_empty_tables(spark, tables, query):
    assert query(spark, tables()).count() == 0


def test_encoding(spark, tables):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", None, " ", "<|endoftext|> x", "a\n\n  b\t", "don't I'LL", "循环在690次之后 über", "x" * 3000, " " * 500, "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0x400, 0x500), 0x1F600))) for _ in range(2000))]
    directory = tables(documents=[(k, t) for k, t in enumerate(texts)] + [(0, ""), (None, "no document")])
    rows = encoding.ids(spark, directory).collect()
    found = {r.doc_id: r.ids for r in rows}
    assert len(rows) == len(texts) and found == {k: reference.encode(t, add_special_tokens=False).ids if t else [] for k, t in enumerate(texts)}


def _contains(text, item, size, words):
    units = (lambda t: re.findall(r"[^\W_]+" if words else r"[^\W_]", t.lower()))
    a, b = units(text), units(item)
    grams = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)}
    return any(tuple(a[k : k + size]) in grams for k in range(len(a) - size + 1))


@pytest.mark.parametrize("bucket", (leakage.BUCKET, 300))
def test_leakage(spark, tables, monkeypatch, bucket):
    """The same rows whether the items fill one bucket or many."""
    monkeypatch.setattr(leakage, "BUCKET", bucket)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(20)), "en") for k in range(12)] + [(99, "只有十二个字的题目而已啊", "zh"), (100, "".join(chr(0x4E00 + rng.randrange(60)) for _ in range(60)), "zh"), (101, "short item", None), (102, None, "en")]
    documents = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 80))]
        if k % 3 == 0:
            own = items[k % 12][1].upper().split()
            at, n = rng.randrange(0, 7), 12 + k % 2
            words[3:3] = own[at : at + n]
        documents.append((k, rng.choice(("_", "\n-- ", ", ")).join(words)))
    documents += [(200, "前言 " + "，".join(items[13][1][20:46]) + " 后"), (201, items[13][1][:25]), (202, None), (203, ""), (204, documents[3][1]), (204, documents[3][1]), (205, "x " * 30000 + items[0][1])]
    found = {tuple(r) for r in leakage.found(spark, tables(documents=documents, benchmark=items)).collect()}
    expected = {(d, i) for d, t in documents for i, x, lang in items if t and x and _contains(t, x, *((26, False) if lang == "zh" else (13, True)))}
    assert found == expected and (200, 100) in found and (205, 0) in found


EASY = "Open the page. Look at the box. It is red. You can see the name. Put it on the desk. We read the map. I like the cat. Do not worry."
MIDDLE = "The reviewer marks the file as incomplete because the second build could not be matched. When the settings change, the report lists every folder that still depends on the older layout."
HARD = "Notwithstanding the provisional admissibility of the aforementioned declarations, the epistemological determinacy of representational commitments remains contingent upon corroborating methodological attestations, whose interdependence systematically undermines conventional aggregation."


def _sample(rng, level):
    pool = [s.strip() + "." for s in (EASY, MIDDLE, HARD)[level - 1].split(".") if s.strip()]
    return " ".join(rng.choice(pool) for _ in range(12 if level == 1 else 6))


def test_reading_levels(spark, tables):
    rng = random.Random(4)
    levels = {k: rng.choice((1, 2, 3)) for k in range(90)}
    documents = [(k, _sample(rng, v), "en") for k, v in levels.items()]
    documents += [(200, None), (201, " \n"), (202, "Die Schleife endet nach einigen Schritten oder bei leerem Puffer, und der Aufrufer muss den Wert vorher prüfen."), (203, "import os\n\ndef f(a):\n    # the value of the list\n    return a\n\nx = f(1)\n")]
    labels = [(k, "a", levels[k]) for k in range(45)] + [(k, "b", None) for k in range(5)] + [(1, "a", levels[1]), (999, "a", 2)]
    found = {r.doc_id: r.reading_level for r in reading.levels(spark, tables(documents=documents + documents[:1], reading_labels=labels)).collect()}
    assert set(found) == set(levels)
    held_out = [found[k] == levels[k] for k in range(45, 90)]
    assert sum(held_out) >= 0.9 * len(held_out)


def test_reading_levels_of_held_out_documents():
    """Levels of graded documents of the tables that the model was not fitted on; raters themselves disagree on about one in ten."""
    duckdb, os = pytest.importorskip("duckdb"), __import__("os")
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("test tables are absent")
    rows = duckdb.sql(
        f"""WITH r AS (SELECT doc_id, rater, avg(reading_level) AS own FROM '{folder}/reading_labels.parquet' WHERE reading_level BETWEEN 1 AND 3 GROUP BY 1, 2),
        g AS (SELECT doc_id, round(avg(own)) AS level FROM r GROUP BY 1) SELECT DISTINCT ON (doc_id) doc_id, level, text FROM g JOIN '{folder}/documents.parquet' USING (doc_id) WHERE text IS NOT NULL ORDER BY doc_id"""
    ).fetchall()
    graded = [(d, level, reading.features(p)) for d, level, text in rows if (p := reading.english_prose(text)) is not None]
    model = reading.Ranker([x for d, _, x in graded if d % 2], [y for d, y, _ in graded if d % 2])
    held_out = [(y, x) for d, y, x in graded if not d % 2]
    right = sum(a == y for a, (y, _) in zip(model.level([x for _, x in held_out]), held_out))
    assert len(held_out) > 100 and right >= 0.88 * len(held_out)
