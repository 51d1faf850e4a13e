"""Functions paired with their documentation (problem 5).

Python goes through the interpreter's syntax tree.  Rust, C and C++ go through the declaration readers, which visit every function node of a file
and give its exact source range; documentation comments and attributes directly above a declaration are attached to it.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings

from pyspark.sql import DataFrame, SparkSession

from factloom.functions.declarations import CReader, RustReader, Tokens, doc_attributes
from factloom.functions.grammar import analyse
from factloom.llm.common import keep_header_language, managed_files, scan, variants

_SCHEMA = "file_id bigint, relative_path string, language string, fn_line bigint, fn_name string, documentation string, code string"

#: Documentation that says nothing.
PLACEHOLDERS = frozenset(
    "todo fixme tbd xxx na none nodocs nodocsyet nodocumentation nodocumentationyet tododocument tododocumentthis documentme undocumented placeholder stub wip tba "
    "addcomment adddocs adddocumentation writeme docme description 待补充 待办 待完善 暂无 無 无 未記入".split()
)
_DOC_TOKENS = re.compile(r"[^\W_]+")


def is_trivial(documentation: str, name: str) -> bool:
    """Empty, a placeholder, or nothing but the words of the name (an inflected first word and articles do not count)."""
    words = [w.lower() for w in _DOC_TOKENS.findall(documentation)]
    if not words or "".join(words) in PLACEHOLDERS or (len(words) <= 3 and words[0] in ("todo", "fixme", "tbd", "xxx")):
        return True
    parts = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+", name)]
    kept = [w for w in words if w not in ("a", "an", "the", "this", "function", "method", "fn", "def")]
    if "".join(kept) == "".join(parts) or "".join(words) == "".join(parts):
        return True
    return bool(kept) and len(kept) == len(parts) and kept[1:] == parts[1:] and kept[0].rstrip("s").rstrip("e") == parts[0].rstrip("e")


def _python(text: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines: list[str] | None = None
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            documentation = ast.get_docstring(node, clean=True)
            if documentation:
                lines = lines if lines is not None else text.split("\n")
                line = node.lineno
                while line < len(lines) and node.name not in lines[line - 1]:
                    line += 1
                yield line, node.name, documentation, "\n".join(lines[node.lineno - 1 : node.end_lineno])
        for field in ("body", "orelse", "finalbody", "handlers", "cases"):
            stack.extend(getattr(node, field, ()) if isinstance(getattr(node, field, None), list) else ())


def _strip_block(comment: str) -> str:
    body = comment[3:-2]
    return "\n".join(re.sub(r"^[ \t]*\*?[ \t]?", "", line) if k else line.strip() for k, line in enumerate(body.split("\n"))).strip()


_BEHIND = re.compile(r"/(?://|\*\*|\*!|/!)<")


def _doc_comment(token: str, rust: bool) -> str | None:
    """Text of a documentation comment that stands before what it documents, ``None`` for any other comment."""
    if not rust and _BEHIND.match(token):
        return None
    if token.startswith("///") and not token.startswith("////") or (not rust and token.startswith("//!")):
        return token[3:]
    if len(token) > 4 and (token.startswith("/**") and token[3] != "*" or (not rust and token.startswith("/*!"))):
        return _strip_block(token)
    return None


def _braced(text: str, language: str, tokens: Tokens):
    """Documented functions of the declaration tree: comments and attributes in a row above a declaration, or between its attributes."""
    rust = language == "rust"
    carriers = [(start, end, _doc_comment(token, rust)) for token, start, end in tokens.comments]
    if rust:
        carriers = sorted(carriers + [(start, end, body) for start, end, body in doc_attributes(tokens)])
    if all(body is None for _, _, body in carriers):
        return
    reader = RustReader(text, tokens) if rust else CReader(text, language, tokens)
    starts = [c[0] for c in carriers]
    for s in reader.subjects:
        if s.kind != "callable" or (s.fixed and s.name.startswith("operator")):
            continue
        parts: list[str] = []
        edge = s.begin
        if rust:  # carriers among the attributes
            for start, end, body in carriers[bisect.bisect_left(starts, s.begin) : bisect.bisect_left(starts, s.head)]:
                if body is None:
                    parts = []
                else:
                    parts.append(body.strip())
        first = bisect.bisect_left(starts, s.begin) - 1
        while first >= 0:
            start, end, body = carriers[first]
            between = text[end:edge]
            if body is None or between.strip() or between.count("\n") > 1 and not (rust and edge == s.begin):
                break
            parts.insert(0, body.strip())
            edge, first = start, first - 1
        if parts:
            yield text.count("\n", 0, s.at) + 1, s.name.removeprefix("r#"), "\n".join(parts).strip(), text[s.head if rust else s.begin : s.end]


def documented_functions(text: str, language: str, tokens: Tokens | None = None):
    """``(fn_line, fn_name, documentation, code)`` of each function of a valid file whose documentation says something."""
    for line, name, documentation, code in _python(text) if language == "python" else _braced(text, language, tokens or Tokens(text, language)):
        if not is_trivial(documentation, name):
            yield line, name, documentation, code


class _Undocumented(Exception):
    """A file without any documentation, of which nothing more need be known."""


#: A docstring stands behind a colon, at most comments and line ends between.
_DOCSTRING = re.compile(rb":(?:[ \t\f\\]|\r?\n|#[^\n]*)*[rRuU]?[\"']")


def _documented(columns: dict[str, list]):
    """Rows of :data:`_SCHEMA`; a file is lexed once for the check of its grammar and the reading of its declarations, one without documentation only lexed."""
    for file_id, path, content in zip(columns["file_id"], columns["relative_path"], columns["content"]):
        read: list[Tokens] = []

        def lexer(text, language):
            # the two languages of a header differ in raw strings alone
            if not read or 'R"' in text:
                read[:] = [Tokens(text, language)]
            rust = language == "rust"
            if not any(_doc_comment(token, rust) is not None for token, _, _ in read[0].comments) and not (rust and any(True for _ in doc_attributes(read[0]))):
                raise _Undocumented
            return read[0].lexed

        for language in variants(path):

            if language == "python" and not _DOCSTRING.search(content or b""):
                continue
            try:
                problem, text, _ = analyse(content, language, lex_python=False, lexer=lexer, words=False)
            except _Undocumented:
                continue
            if problem is None and text:
                for line, name, documentation, code in documented_functions(text, language, read[0] if read else None):
                    yield file_id, path, language, line, name, documentation, code


def pairs(spark: SparkSession, directory: str) -> DataFrame:
    """``(file_id, relative_path, fn_line, fn_name, documentation, code)`` once per function; damaged, empty and null files give none."""

    rows = keep_header_language(scan(managed_files(spark, directory), _documented, _SCHEMA), spark, directory)
    return rows.drop("language").dropDuplicates(["file_id", "fn_line", "fn_name"])


def found(spark: SparkSession, directory: str) -> DataFrame:
    """``p5_found(file_id, fn_line, fn_name)``: the pairs without their texts, which are pruned before the only shuffle."""

    def per_slice(columns):
        return ((*row[:5],) for row in _documented(columns))

    rows = scan(managed_files(spark, directory), per_slice, "file_id bigint, relative_path string, language string, fn_line bigint, fn_name string")
    return keep_header_language(rows, spark, directory).select("file_id", "fn_line", "fn_name").distinct()
