"""Operators over source files against brute force and hand-made cases; every fixture has nulls, empties, repeats and clashing columns."""

import random

import pytest

from factloom.llm import docpairs, languages, licenses, parseability, provenance, shared_spans

QUERIES = (parseability.found, parseability.rates, languages.found, provenance.found, docpairs.found, licenses.licenses, shared_spans.found, shared_spans.shares)


@pytest.mark.parametrize("query", QUERIES)
def test_empty_tables(spark, tables, query):
    assert query(spark, tables()).count() == 0


def test_parseability(spark, tables, source_rows):
    files = {"a/x.py": "x = (\n", "a/y.py": "x = 1\n", "a/z.rs": "", "a/n.c": None, "a/v.h": "class A { int x; };\n", "a/w.h": "class A { int x; };\n", "a/t.txt": "((", "a/u.cc": b"\xff"}
    directory = tables(source_documents=source_rows(files), header_languages=[("a/w.h", "cpp")])
    assert sorted(r.file_id for r in parseability.found(spark, directory).collect()) == [1, 5, 8]
    rates = {(r.repo, r.language): (r.files, r.damaged) for r in parseability.rates(spark, directory).collect()}
    assert rates == {("a", "python"): (2, 1), ("a", "rust"): (1, 0), ("a", "c"): (2, 1), ("a", "cpp"): (2, 1)}


def test_languages(spark, tables, source_rows):
    files = {
        "a/x.py": 'import os\n\ndef f():\n    """The first entries belong to the list and the rest to this one."""\n    # Die Schleife endet nach einigen Schritten oder bei leerem Puffer\n    return "\\u8c03\\u7528\\u65b9\\u5fc5\\u987b\\u5148\\u68c0\\u67e5\\uff0c\\u518d\\u91ca\\u653e\\u5185\\u5b58"\n',
        "a/y.rs": "// We read each value once because it may change\nfn f() { let s = \"no docs\"; }\n// if x > 15.24 { return y; }\n",
        "a/z.c": "int x;\n/* La première colonne appartient au groupe orbite */\n// до освобождения памяти вызывающий код должен проверить значение\n",
        "a/n.py": None, "a/e.py": "", "a/j.cpp": "int x;\n// 呼び出し側は格子を確認してから光線を解放すること\n", "a/bad.py": "(\n# This sentence has more than four words\n",
    }
    found = sorted((r.file_id, r.lang) for r in languages.found(spark, tables(source_documents=source_rows(files))).collect())
    assert found == [(1, "de"), (1, "en"), (1, "zh"), (3, "fr"), (3, "ru"), (6, "ja")]


def test_prose_that_ends_like_code(spark, tables, source_rows):
    """A stray bracket or semicolon does not make a sentence code; commented-out code stays out."""
    prose = {
        "en": "Callers must hold the gradient lock while they sample the shard {", "es": "La primera fila pertenece al grupo espectro de la tabla (#209) {",
        "de": "Wird nur einmal gelesen, weil es sonst veraltet ist;", "fr": "ne pas modifier tant que c'est encore utilisé (#708) }",
    }
    code = ("if (horizon > 272.5917) return horizon;", "if ingot > 44.2729 { return residual; }", "for value in items: total = total + value", "unsigned long long int counter;", "merge(alpha, beta, gamma, delta);", "let mut count = first + second;")
    files = {f"a/{language}.rs": f"fn f() {{}}\n// {line}\n" for language, line in prose.items()} | {"a/code.rs": "fn f() {}\n" + "".join(f"\n// {line}\n" for line in code)}
    found = sorted((r.file_id, r.lang) for r in languages.found(spark, tables(source_documents=source_rows(files))).collect())
    assert found == [(k, language) for k, language in enumerate(prose, 1)]
    assert all(languages.is_code(line) for line in code)
    for line in ("use the old value {", "for each of the values in the list: keep the first;", "falls back to 724 samples when the profile has no ingot {", "return early so that the other part stays as it was;"):
        assert not languages.is_code(line)


def test_language_accuracy():
    """Sentences of the seeds decode to their language; held-out lines are tested below."""
    model = languages.SpanModel({})
    for language in ("en", "de", "fr", "es", "ru"):
        lines = [x.strip() for x in languages._SEEDS[language].split(".") if len(x.split()) >= 6]
        decoded = languages.decode_spans(model, [(x, 1.0) for x in lines])
        assert sum(list(d) == [language] for d in decoded) >= 0.8 * len(lines)


def test_provenance(spark, tables, source_rows):
    hand = "def f{0}(x):\n    y = x + {0}\n    if y > 3:\n        return y\n    return [q * {0} for q in (x, y)]\n\n\n"
    files = {
        "a/vendor/q/x.py": "x = 1\n", "a/src/vendor_portal/x.py": hand.format(1) * 9, "a/src/x.js": "var " + ",".join(f"a{k}=function(b){{return b*{k}}}" for k in range(80)),
        "a/src/t.c": "/* @generated by toolgen 1.0 */\nint x;\n", "a/src/u.rs": "// Imported copy of other-lib 1.2; send fixes upstream.\npub fn f() {}\n",
        "a/src/d.py": "T = [\n" + "".join(f"    0x{k * 977 % 65536:04x}, 0x{k * 31:04x},\n" for k in range(60)) + "]\n",
        "a/src/s.py": 'N = "This file is generated by grid; do not edit it by hand"\n# do not edit: see notes\n' + hand.format(2), "a/src/n.c": None, "a/src/e.c": "",
        **{f"r{k}/src/same.py": "".join(f"def shared_{j}(alpha, beta):\n    gamma = alpha * {j} - beta\n    return gamma + delta_{j}(beta)\n\n" for j in range(12)) for k in range(6)},
    }
    rows = source_rows(files)
    found = {r.file_id: r.signs for r in provenance.flagged(spark, tables(source_documents=rows)).collect()}
    assert sorted(found) == [1, 3, 4, 5, 6, *range(10, 16)]
    assert found[3] == "minified" and "generated_notice" in found[4] and "outside_notice" in found[5] and "data" in found[6] and "recurring" in found[10]


def test_repositories_are_counted_exactly(spark, tables, source_rows):
    """Copies in exactly REPOSITORIES repositories are found, whatever their names hash to; copies in one fewer are not."""
    names = [f"r{k}" for k in range(200)]
    slots = {r.id: r.slot for r in spark.createDataFrame([(n,) for n in names], "id string").selectExpr("id", "pmod(xxhash64(id), 64) AS slot").collect()}
    slot = max(slots.values(), key=list(slots.values()).count)
    alike = [n for n in names if slots[n] == slot][:2]
    five, four = alike + [n for n in names if slots[n] != slot][:3], [n for n in names if slots[n] != slot][3:7]
    body = lambda word: "".join(f"def {word}_{j}(alpha, beta):\n    gamma = alpha * {j} - beta\n    return gamma + {word}_delta_{chr(97 + j)}(beta)\n\n" for j in range(12))
    files = {f"{n}/src/{k}.py": body("shared") for n in five for k in "xy"} | {f"{n}/src/{k}.py": body("other") for n in four for k in "xy"}
    assert len(alike) == 2
    found = sorted(r.file_id for r in provenance.found(spark, tables(source_documents=source_rows(files))).collect())
    assert found == list(range(1, 11))


def test_documentation_pairs(spark, tables, source_rows):
    files = {
        "a/x.py": 'class A:\n    @d\n    async def run_all(\n        self):\n        """Runs every job once."""\n    def go(self):\n        """Go."""\n    def todo(self):\n        """TODO: document"""\n',
        "a/y.rs": '/// Adds both numbers\n#[inline]\npub(crate) fn add(a: u8) {}\n// no documentation here\nfn b() {}\n#[doc = "Text of two"]\n#[doc = "lines"]\nfn c() {}\n//// four slashes\nfn d() {}\n/** */\nfn e() {}\n',
        "a/z.cpp": "/// Keeps the value below ten\ntemplate <typename T>\n[[nodiscard]] static inline double\nkeep(T x);\nclass Q {\npublic:\n    /** Doc of a class member\n     */\n    int get() const { return 1; }\n    /* ordinary */\n    int other();\n};\n/** About a table */\nstatic const int TABLE[] = {f(1)};\n",
        "a/n.py": None, "a/e.rs": "",
    }
    directory = tables(source_documents=source_rows(files))
    found = sorted(tuple(r) for r in docpairs.found(spark, directory).collect())
    assert found == [(1, 3, "run_all"), (2, 3, "add"), (2, 8, "c"), (3, 4, "keep"), (3, 9, "get")]
    pairs = {r.fn_name: (r.documentation, r.code) for r in docpairs.pairs(spark, directory).collect()}
    assert pairs["c"][0] == "Text of two\nlines" and pairs["add"][1] == "pub(crate) fn add(a: u8) {}"


def test_documented_heads():
    """An ABI literal, parentheses in template arguments and names that begin with "operator" do not hide a function."""
    rust = '/// Adds both given numbers\npub unsafe extern "C" fn add(a: u8) {}\n/// Frees what was given\nextern fn release() {}\n'
    assert [f[:2] for f in docpairs.documented_functions(rust, "rust")] == [(2, "add"), (4, "release")]
    cpp = (
        '/// Reads one value of it\nextern "C" int load(int x);\n/// Gives what is called later\nstd::function<void(int)> later(int x);\n/// Tells how many there are\nint operator_count(int x);\n'
        "/// Adds two of a kind\nT operator+(T x);\n/// Makes it a number at once\noperator int() const;\n/// Keeps nested ones of each\nstd::map<int, std::function<bool(int, char)>> nested();\n"
    )
    assert [f[:2] for f in docpairs.documented_functions(cpp, "cpp")] == [(2, "load"), (4, "later"), (6, "operator_count"), (12, "nested")]


def test_licenses(spark, tables, source_rows):
    body = "Everybody may copy\n// this work in any shape they like. Nobody answers\n// for what breaks."
    files = {
        "a/LICENSE": "Alder Public License\nVersion 1.0\n", "a/src/x.py": "x = 1\n", "a/src/y.py": "# SPDX-License-Identifier: BBB-2.0\nx = 1\n", "a/vendor/COPYING.txt": "# Birch Terms 3.0\n",
        "a/vendor/q/z.c": "int x;\n", "a/vendor/q/w.c": f"// {body}\nint x;\n", "b/COPYING": "ask first", "b/x.rs": "// License: bbb v3.0\nfn f() {}\n", "b/y.rs": "fn f() {} // License: bbb v3.0\n",
        "c/LICENSE": "AAA-1.0", "c/COPYING": "BBB-2.0", "c/x.c": None, "d/x.c": "", "a/src/s.py": 'N = "SPDX-License-Identifier: BBB-2.0"\n',
    }
    found = {(r.repo, r.file_id): r.license_id for r in licenses.licenses(spark, tables(source_documents=source_rows(files))).collect()}
    assert found == {
        ("a", -1): "AAA-1.0", ("a", 2): "AAA-1.0", ("a", 3): "conflict", ("a", 5): "BBB-3.0", ("a", 6): "conflict", ("b", -1): "unknown", ("b", 8): "BBB-3.0", ("b", 9): "unknown",
        ("c", -1): "conflict", ("c", 12): "conflict", ("d", -1): "unknown", ("d", 13): "unknown", ("a", 14): "AAA-1.0",
    }


def test_bounds_are_errors(spark, tables, monkeypatch):
    """A catalogue beyond its bound is refused, not cut; at the bound it is taken."""
    directory = tables()
    monkeypatch.setattr(licenses, "CATALOGUE_ROWS", 3)
    assert licenses.licenses(spark, directory).count() == 0
    monkeypatch.setattr(licenses, "CATALOGUE_ROWS", 2)
    with pytest.raises(ValueError):
        licenses.licenses(spark, directory)


def _longest(a: bytes, b: bytes, size: int) -> bool:
    grams = {a[k : k + size] for k in range(len(a) - size + 1)}
    return any(b[k : k + size] in grams for k in range(len(b) - size + 1))


def test_shared_spans(spark, tables, source_rows):
    rng = random.Random(5)
    common = [bytes(rng.randrange(256) for _ in range(n)) for n in (400, 399, 900)]
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    files = {"a/0": noise(50) + common[0] + noise(10), "a/1": common[0], "a/2": noise(900) + common[1], "a/3": common[1] + noise(700), "a/4": common[2] + noise(500), "a/5": noise(3) + common[2] + common[0], "a/6": None, "a/7": b"", "a/8": common[2] + noise(1)}
    files |= {"b/0": files["a/5"], "b/1": files["a/5"], "b/2": b"ab" * 400, "b/3": b"ba" * 450}
    directory = tables(source_documents=source_rows(files))
    found = {tuple(r) for r in shared_spans.found(spark, directory).collect()}
    contents = dict(enumerate(files.values(), 1))
    expected = {(i, j) for i in contents for j in contents if i < j and contents[i] and contents[j] and _longest(contents[i], contents[j], 400)}
    assert found == expected
    shares = {r.file_id: r.shared_bytes for r in shared_spans.shares(spark, directory).collect()}
    assert shares[1] == 400 and shares[2] == 400 and shares[3] == 0 and shares[5] == 900 and shares[10] == len(files["b/0"]) and shares[7] == 0


def test_copies_by_fingerprints_alone(spark, tables, source_rows):
    """Copies are found without any path or notice, whatever their layout and comments; edited ones, and forks of one repository, are not."""
    body = lambda word, n=12: "".join(f"int {word}_{j}(int alpha, int beta) {{\n    int gamma = alpha * {j} - beta;\n    return gamma + {word}_{j + 1}(beta);\n}}\n\n" for j in range(n))
    files = {f"r{k}/src/copy{k}.c": (f"// file {k}\n" + body("shared").replace("\n    ", "\n" + " " * k + "    ")) for k in range(6)}
    files |= {f"q{k}/src/edited.c": body("other", 6) + body(f"own_{k}", 6) for k in range(6)}
    files |= {f"f{k}/src/{name}.c": body(name) for k in range(6) for name in ("one", "two", "three", "four")}
    found = {r.file_id for r in provenance.found(spark, tables(source_documents=source_rows(files))).collect()}
    assert found == set(range(1, 7))


def test_signs_of_whole_files():
    """Notices at the end count behind comments of any length; people are no tools; few lines can be data, none are a listing."""
    text = "int f(void) { return 1; }\n"
    assert provenance.signs("a/x.c", text + "// filler line of a comment\n" * 500 + "// @generated by toolgen\n") == ["generated_notice"]
    assert provenance.signs("a/x.c", text + "/* " + "filler " * 1000 + "\n Upstream: other-lib 3.2 (synced as is) */\n\n") == ["outside_notice"]
    assert provenance.signs("a/x.c", text + "/*\n * Upstream: other-lib 3.2 (synced as is)\n" + " * filler\n" * 900 + " */\n\n") == ["outside_notice"]
    assert provenance.signs("a/x.py", "# This module was created by Bob in 2019\nx = 1\n") == []
    assert provenance.signs("a/x.py", "# This module was created by beamgen 3.1\nx = 1\n") == ["generated_notice"]
    assert "data" in provenance.signs("a/x.py", "T = [0x1f2e, 0x3d4c, 0x5b6a, 0x7988]\n")
    listing = "".join(f"register_value({k * 7}, 'name');\n" for k in range(70)) + "".join(f"{c}_{c}({c});\n" for c in "abcdefghijklmnopqrst")
    assert "repetitive" in provenance.signs("a/x.js", listing)


GPL = [("GPL-2.0", "General Public Terms", "2.0", "", "x"), ("GPL-3.0", "General Public Terms", "3.0", "", "x"), ("MIT", "MIT Grant", None, "", "x"), ("LGPL-2.1", "Lesser Public Terms", "2.1", "", "x"), ("GPL-2.0 WITH Linking-exception", None, None, "", "x")]


def test_licence_statements():
    matcher = licenses.Matcher([row[:4] for row in GPL])
    read = lambda text: matcher.read(text)[:2]
    assert read("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0") == (["GPL-2.0"], False)
    assert matcher.read("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0").exceptions == ["classpath 2"]
    assert read("GPL-2.0 WITH Linking-exception") == (["GPL-2.0 WITH Linking-exception"], False)
    later = matcher.read("SPDX-License-Identifier: GPL-2.0-or-later")
    assert later.stated == ["GPL-2.0"] and later.allowed == ["GPL-2.0", "GPL-3.0"] and matcher.read("GPL-2.0+").allowed == ["GPL-2.0", "GPL-3.0"] and matcher.read("GPL-2.0-only").allowed == ["GPL-2.0"]
    assert read("GPL-2.0 OR LGPL-2.1") == (["GPL-2.0", "LGPL-2.1"], True) and read("GPL-2.0 AND LGPL-2.1") == (["GPL-2.0", "LGPL-2.1"], False)
    assert read("GPL-2.0-or-later OR LGPL-2.1") == (["GPL-2.0", "LGPL-2.1"], True) and read("GPL-2.0 or later and LGPL-2.1") == (["GPL-2.0", "LGPL-2.1"], False)
    assert read("either the General Public Terms version 2, or (at your option) the Lesser Public Terms 2.1") == (["GPL-2.0", "LGPL-2.1"], True)
    assert read("this is not GPL-2.0") == ([], False) and read("no longer under the terms of the GPL-2.0, but LGPL-2.1") == (["LGPL-2.1"], False) and read("formerly GPL-2.0") == ([], False)
    assert read("GPLv2") == (["GPL-2.0"], False) and read("GPL v3.0") == (["GPL-3.0"], False) and read("GPL") == ([], False) and read("") == ([], False)


def test_licence_choices_and_repositories(spark, tables, source_rows):
    files = {
        "a/LICENSE": "General Public Terms 3.0", "a/w.c": "// GPL-2.0 OR GPL-3.0\nint x;\n", "a/x.c": "// GPL-2.0-or-later\nint x;\n", "a/y.c": "// GPL-2.0 OR LGPL-2.1\nint x;\n", "a/z.c": "int x;\n",
        "b/x.c": "// LGPL-2.1 OR GPL-2.0\nint x;\n", "b/y.c": "// LGPL-2.1 AND GPL-2.0\nint x;\n", "b/z.c": "int x;\n",
    }
    directory = tables(source_documents=source_rows(files), license_catalog=GPL)
    found = {(r.repo, r.file_id): r.license_id for r in licenses.licenses(spark, directory).collect()}
    assert found == {("a", -1): "GPL-3.0", ("a", 2): "GPL-3.0", ("a", 3): "GPL-2.0", ("a", 4): "conflict", ("a", 5): "GPL-3.0", ("b", -1): "unknown", ("b", 6): "LGPL-2.1", ("b", 7): "conflict", ("b", 8): "unknown"}
    repositories = {r.repo: tuple(r)[1:] for r in licenses.repositories(spark, directory).collect()}
    assert repositories == {"a": ("GPL-3.0", 4, 2, 1, 1, 0, 2), "b": ("unknown", 3, 1, 1, 1, 1, 1)}
    assert {r.file_id: (r.stated, r.choice) for r in licenses.terms(spark, directory).collect()}[7] == ("LGPL-2.1 GPL-2.0", False)


def test_documentation_of_unusual_heads():
    """Comments and line breaks before a body, returned function pointers, attributes and templates on the way; no macros, operators or objects."""
    found = lambda text, language: [f[:2] for f in docpairs.documented_functions(text, language)]
    body = "/** Adds both given numbers */\nint add(int a, int b) /* note */" + "\n" * 300 + "{ return a + b; }\n"
    assert found(body, "c") == found(body, "cpp") == [(2, "add")]
    assert found("/** Gives what is called later */\nint (*later(int x))(char);\n/** Counts up to the end */\nCOUNT_TO(end);\n/** Holds what is called */\nint (*held)(char);\n/** Names the kind of it */\ntypedef int (*kind)(char);\n", "c") == [(2, "later")]
    assert found("struct A {\n/// Tells whether it is set\noperator bool() const;\n/// Adds two of a kind\nA operator+(A);\n/// Makes one of a number\nexplicit A(int x) : b{x} {}\n/// Frees all that it holds\n~A();\n};\n", "cpp") == [(7, "A"), (9, "~A")]
    assert found("/// Keeps it below the bound\ntemplate <typename T, int N = (3 > 2)>\n[[nodiscard]] auto keep(T x) -> std::vector<T>;\n\n/// Far above\n\nint far(int x);\n", "cpp") == [(3, "keep")]
    assert found('/// Adds both given numbers\n#[cfg(x)]\n#[doc = r#"and says so"#]\npub const unsafe extern "C" fn add(a: u8) {}\nfn outer() {\n    /// Works on the inside\n    fn inner() {}\n}\nm! {\n    /// Is only a pattern\n    fn none() {}\n}\n', "rust") == [(4, "add"), (7, "inner")]


def test_held_out_lines():
    """Lines of labelled documents that the model was not fitted on decode to their language."""
    duckdb, os = pytest.importorskip("duckdb"), __import__("os")
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are absent")
    rows = duckdb.sql(f"SELECT doc_id, lower(lang) AS lang, text FROM '{path}' WHERE text IS NOT NULL AND source <> 'code'").fetchall()
    rows = [(d, lang, text) for d, lang, text in rows if lang in languages.LANGUAGES]
    fitted_on = {text for d, _, text in rows if d % 2}
    seen = {line for text in fitted_on for line in text.split("\n")}
    model = languages.fitted([(lang, text[: languages.SAMPLE_CHARACTERS]) for d, lang, text in rows if d % 2])
    right, total = {}, {}
    for d, lang, text in rows:
        if d % 2 or text in fitted_on or model.likeliest(text) != lang:
            continue  # wrong labels are planted; the whole text tells
        for line in text.split("\n"):
            if line not in seen and languages.prepared(line) and not languages.is_code(line) and (lang in ("zh", "ja") or len(line.split()) > 7):
                languages._cache.clear()
                found = languages.decode_spans(model, [(line, 1.0)])[0]
                total[lang] = total.get(lang, 0) + 1
                right[lang] = right.get(lang, 0) + (lang in found)
    assert set(total) == set(languages.LANGUAGES)
    assert all(right[k] >= 0.97 * total[k] for k in total), (right, total)


def test_shares_in_characters_of_the_file(spark, tables, source_rows):
    prose = "Keep the block_size value 42 of every reader below the limit that was agreed on with all of its many users."
    escaped = "".join(f"\\u{ord(c):04x}" for c in "任何人不得使为奴隶或奴役")
    files = {"a/x.c": f"int x;\n// {prose}\n", "a/y.py": f'x = "{escaped}"\n', "a/z.c": '#define TEXT "what do you want to do now" // and nothing else is left to say\nint x;\n', "a/w.c": "int x;\n// reads block_size bytes only\n// with read_ahead turned on\n"}
    found = {(r.file_id, r.lang): (r.characters, r.share) for r in languages.language_shares(spark, tables(source_documents=source_rows(files))).collect()}
    assert found[1, "en"] == (len(prose), round(len(prose) / (len(prose) + 11), 6)) and len(prose) == 107
    assert found[2, "zh"] == (72, round(72 / (len(escaped) + 7), 6))
    assert found[3, "en"][0] == len("what do you want to do now") + len("and nothing else is left to say") and (4, "en") in found and len(found) == 4
