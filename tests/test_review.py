import json

import pytest

from factloom.functions.observe import observe
from factloom.plans import review as plan
from factloom.sources.authority import Authority, Rejection, admit

WORDS = "calculate velocity distance duration sample value the parser file class main item read".split()


def run(spark, files, revision="r1", **fields):
    facts = admit(json.dumps({"schema_version": 4, "token_vocabulary": WORDS} | fields))
    documents = spark.createDataFrame([(p, bytearray(t.encode() if isinstance(t, str) else t)) for p, t in files.items()], "relative_path string, content binary")
    return plan.review(documents, facts, revision)


def found(result):
    return sorted((r.path, r.rule, r.line, r.subject) for r in result.findings.collect())


GOOD = '''def calculate_velocity(distance):
    """
    计算速度

    Args:
        distance: 距离
    Returns:
        速度
    Raises:
        无
    """
    return distance
'''


def test_source_rules_and_coverage(spark):
    result = run(
        spark,
        {
            "a.py": "value = 1  # trailing\n# First sentence. Second\n# shape (a)\n# `code.` https://x.y/z.\n",
            "b.py": b"value = '\xff'\n",
            "c.py": "def calculate(:\n",
            "d.py": "value = 1  # noqa: E501\n",
            "e.py": "",
        },
    )
    rules = found(result)
    assert ("a.py", "source.trailing_comment", 1, "") in rules and ("a.py", "source.comment_punctuation", 2, "") in rules and ("a.py", "source.comment_parentheses", 3, "") in rules
    assert [r[0] for r in rules if r[1] == "source.parseability"] == ["b.py", "c.py"] and not [r for r in rules if r[0] in ("d.py", "e.py")]
    cells = {(r.path, r.family): (r.state, r["count"], r.reason) for r in result.coverage.collect()}
    assert len(cells) == 30 and cells["a.py", "physical_lines"][1] == 4 and cells["e.py", "physical_lines"][1] == 0
    assert [cells["b.py", f][0] for f in ("capture", "physical_lines", "structure", "identifier", "documentation", "dependency_declaration")] == ["complete"] * 2 + ["blocked"] * 4
    assert "rejected source at 1:10: source is not valid UTF-8" in cells["b.py", "structure"][2]
    assert result.summary["metrics"] == {"files_read": 5, "byte_sweeps": 5, "structural_parses": 4} and result.disposition == "incomplete"


def test_names(spark):
    files = {"a.py": "x = 1\nmystery = 2\nsampleValue = 3\ndistance = 4\ndistance_s = 5\ndistance_m = 6\nmin_value = 7\nalpha = 8\n"}
    result = run(spark, files, quantity_concepts={"distance": ["m"], "duration": ["s"]})
    by = {r.subject: (r.rule, r.grade) for r in result.findings.collect()}
    assert by == {
        "x": ("identifier.candidate", "review_required"), "mystery": ("identifier.unknown_token", "review_required"), "sampleValue": ("identifier.canonical_form", "hard_violation"),
        "distance": ("identifier.representation_suffix", "hard_violation"), "distance_s": ("identifier.representation_suffix", "hard_violation"), "min_value": ("identifier.canonical_form", "hard_violation"),
        "alpha": ("identifier.candidate", "review_required"),
    }


def test_documentation(spark):
    misaligned = GOOD.replace("distance: 距离", "distance:  距离")
    undocumented = "def calculate_velocity(distance):\n    return distance\n"
    result = run(spark, {"a.py": GOOD.replace("(distance):", "(distance) -> float:"), "b.py": misaligned, "c.py": undocumented, "d.rs": "/// 计算速度\n///\n/// # Arguments\n/// - 无\n/// # Returns\n/// - 无\n/// # Errors\n/// - 无\npub fn calculate() {}\npub unsafe fn read() {}\n"})
    rules = {(r.path, r.rule) for r in result.findings.collect()}
    assert not [r for r in rules if r[0] == "a.py"]
    assert ("b.py", "documentation.public_contract") in rules and ("c.py", "documentation.carrier") in rules and ("d.rs", "documentation.carrier") in rules
    assert ("d.rs", "documentation.public_contract") not in rules
    cells = {(r.path, r.family): r.reason for r in result.coverage.collect()}
    assert cells["c.py", "documentation"] == "unresolved callable documentation facts: calculate_velocity@1:5[return]" and cells["a.py", "documentation"] is None


def test_documentation_attributes_of_rust(spark):
    """#[doc = "..."] and comments are one text in source order; literals are decoded, values that are no literal block the family."""
    body = "/// # Arguments\n#[doc = \"- 无\"]\n/// # Returns\n#[inline]\n/// - 无\n#[doc = r#\"# Errors\"#]\n/// - 无\npub fn calculate() {}\n"
    files = {
        "a.rs": '#[doc = "计算\\u{901f}度"]\n///\n' + body, "b.rs": '#[doc = "计算\\\n    速度\\n\\n# Arguments"]\n' + body.replace("/// # Arguments\n", ""), "c.rs": '#[doc = "x"]\npub fn calculate() {}\n',
        "d.rs": '/// 计算速度\n#[doc = include_str!("a.md")]\nfn calculate() {}\n', "e.rs": "#[doctor]\nfn calculate() {}\n",
    }
    result = run(spark, files)
    rules = {(r.path, r.rule) for r in result.findings.collect() if r.rule.startswith("documentation.")}
    assert rules == {("c.rs", "documentation.summary"), ("c.rs", "documentation.public_contract"), ("e.rs", "documentation.carrier")}
    blocked = [r.path for r in result.coverage.filter("family = 'documentation' AND state = 'blocked'").collect()]
    assert blocked == ["d.rs"]


def test_patterns_of_rust():
    source = "fn f((a, b): (u8, u8), n: u8) {\n    let (c, mut d) = g();\n    if let Some(e) = h { }\n    let Point { x: k, y } = p;\n    for (i, v) in w.iter() { }\n    let z: u8 = q.map(|(l, m): (u8, Vec<u8>), &o| l | m | o);\n    match r {\n        Some(s) if s > t => 1,\n        Kind::One { u } | Kind::Two(u) => { 2 }\n        other @ (3 | 4) => other,\n        None => 5,\n    }\n}\nimpl Shape for Other { fn j() {} }\n"
    names = [f[3] for f in observe(source.encode(), "rust") if f[0] == "name" and f[4] == "variable"]
    assert sorted(names) == sorted("a b n c d e k y i v z l m o s u u other".split())


DEPENDENCY = {"python_standard_library": ["os", "sys"], "python_third_party": ["numpy"], "python_project_roots": ["project"], "python_reorder_safe": True, "rust_reorder_safe": True}


def test_dependencies(spark):
    files = {
        "a.py": "import os\nimport sys\n\nimport numpy\n\nimport project.main\n", "b.py": "import sys\nimport os\n", "c.py": "import numpy\nimport os\n", "d.py": "import sys\nimport mystery\nimport os\n",
        "e.py": "from project import *\n", "f.rs": "use std::{b2, b10, self};\nuse a::*;\n",
        "g.cpp": "int value;\nimport m;\n", "h.cpp": "module;\n#include <a.h>\nimport m;\n", "i.cpp": "#if A\nint value;\n#endif\nimport m;\n",
    }
    result = run(spark, files, dependency_authority=DEPENDENCY)
    rules = [(r.path, r.rule, r.line) for r in result.findings.collect() if r.rule.startswith("dependency.")]
    assert ("b.py", "dependency.order", 2) in rules and ("c.py", "dependency.order", 2) in rules and not [r for r in rules if r[0] in ("a.py", "d.py", "i.cpp")]
    assert ("e.py", "dependency.wildcard", 1) in rules and ("f.rs", "dependency.wildcard", 2) in rules and ("f.rs", "dependency.order", 1) in rules
    assert ("g.cpp", "dependency.module_placement", 2) in rules and ("h.cpp", "dependency.module_placement", 3) in rules
    cells = {(r.path, r.family): r.reason for r in result.coverage.collect()}
    assert cells["d.py", "dependency_declaration"] == "classification is absent from Authority at 2:8: mystery" and cells["a.py", "dependency_declaration"] is None
    assert "target and preprocessing analysis is unsupported at 2:1" in cells["h.cpp", "dependency_declaration"]


def test_tiers_of_c(spark):
    header = "/** 计算速度 */\ndouble calculate_velocity(double distance);\n"
    listed = run(spark, {"a.h": header}, header_languages={"a.h": "c"}, public_callables={"a.h": ["calculate_velocity"]})
    assert ("a.h", "documentation.public_contract", 2, "calculate_velocity") in found(listed)
    unlisted = run(spark, {"a.h": header}, header_languages={"a.h": "c"})
    assert unlisted.coverage.filter("family = 'documentation'").first().reason == "unresolved callable documentation facts: calculate_velocity@2:8[tier]"


def test_identity_and_projections(spark):
    files = {"b.py": "x = 1\n", "a.py": "mystery = 1\n"}
    first, second = run(spark, files), run(spark, dict(reversed(files.items())))
    assert plan.to_json(first) == plan.to_json(second) and plan.canonical(first) == plan.canonical(second)
    assert run(spark, {**files, "a.py": "mystery = 2\n"}).summary["seal"] != first.summary["seal"]
    body = json.loads(plan.to_json(first))
    assert body["terminal"] == "sealed" and [f["rule"] for f in body["review"]["findings"]] == ["identifier.candidate", "identifier.unknown_token"]
    assert "a.py:1:1 mystery mystery" in plan.to_text(first)
    clean = run(spark, {"a.py": "value = 1\n"})
    assert clean.disposition == "clean" and "none" in plan.to_text(clean)


def test_rejections(spark):
    for files, revision in (({"a.txt": ""}, "r"), ({"a.py": ""}, " "), ({"/a.py": ""}, "r"), ({"a/../b.py": ""}, "r"), ({"x.h": ""}, "r")):
        with pytest.raises(Rejection):
            run(spark, files, revision)


def test_workspace(spark, tmp_path):
    from factloom.__main__ import main

    (tmp_path / "w" / ".dot").mkdir(parents=True)
    (tmp_path / "w" / "__init__.py").write_text("")
    (tmp_path / "w" / ".dot" / "a.py").write_text("value = 1\n")
    (tmp_path / "w" / "notes.md").write_text("x")
    (tmp_path / "w" / "link.py").symlink_to(tmp_path / "w" / "__init__.py")
    result = plan.review_workspace(spark, str(tmp_path / "w"), Authority(token_vocabulary=("value",)))
    assert result.scope["value"]["files"] == 2 and result.disposition == "clean"
    (tmp_path / "authority.json").write_text('{"schema_version": 4, "token_vocabulary": ["value"]}')
    assert main(["review", "--authority", str(tmp_path), "--workspace", str(tmp_path / "w")]) == 0
    assert main(["review", "--authority", str(tmp_path / "none"), "--workspace", str(tmp_path / "w"), "--format", "json"]) == 2


def test_workspace_paths_and_written_results(spark, tmp_path):
    """Paths that are no Unicode or collide are rejected before anything is read; the written projection has the findings in order."""
    import os

    from factloom.sources.workspace import check_paths

    (tmp_path / "w" / "a").mkdir(parents=True)
    (tmp_path / "w" / "a" / "b.py").write_text("mystery = 1\nx = 2\n")
    check_paths(str(tmp_path / "w"))
    result = plan.review_workspace(spark, str(tmp_path / "w"), Authority(token_vocabulary=("value",)))
    plan.write_json(result, str(tmp_path / "out"))
    lines = [json.loads(line) for part in sorted(os.listdir(tmp_path / "out" / "findings")) if part.startswith("part") for line in open(tmp_path / "out" / "findings" / part)]
    assert [(r["rule"], r["line"]) for r in lines] == [(f["rule"], f["line"]) for f in json.loads(plan.to_json(result))["review"]["findings"]] and len(lines) == 2
    (tmp_path / "w" / "a\\b.py").write_text("")
    with pytest.raises(Rejection):
        check_paths(str(tmp_path / "w"))
    os.remove(tmp_path / "w" / "a\\b.py")
    with open(os.path.join(os.fsencode(tmp_path / "w"), b"\xff.py"), "wb"):
        pass
    with pytest.raises(Rejection):
        plan.review_workspace(spark, str(tmp_path / "w"), Authority())
