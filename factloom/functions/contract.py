"""Documentation contracts: carrier text, summary, sections, fields, alignment, empty markers, narrative, effect and safety."""

from __future__ import annotations

import re

from factloom.functions import prose

#: Headings in order, aligned sections, delimiter and empty value of each language.
HEADINGS = {
    "python": ("Args:", "Returns:", "Raises:"),
    "rust": ("# Arguments", "# Returns", "# Errors"),
    "c": ("参数：", "返回：", "错误："),
    "cpp": ("参数：", "返回：", "错误："),
}
ALIGNED = {"python": ("Args:", "Returns:", "Raises:"), "rust": ("# Arguments",), "c": ("参数：",), "cpp": ("模板参数：", "参数：")}
EMPTY = {"python": "无", "rust": "- 无", "c": "- 无", "cpp": "- 无"}
NEVER_RETURNS = "- 不返回"
_ALL = {"python": {"Args:", "Returns:", "Raises:"}, "rust": {"# Arguments", "# Returns", "# Errors", "# Panics", "# Safety"}, "c": {"参数：", "返回：", "错误："}, "cpp": {"模板参数：", "参数：", "返回：", "错误：", "效果："}}
_CJK_PAIR = re.compile("[一-鿿]{2}")


def required_headings(language: str, template: bool, effect: bool, unsafe: bool) -> tuple[str, ...]:
    """The heading sequence a public callable must have, optional Rust panics apart."""
    out = list(HEADINGS[language])
    if language == "cpp":
        out = (["模板参数："] if template else []) + out + (["效果："] if effect else [])
    if language == "rust" and unsafe:
        out.append("# Safety")
    return tuple(out)


def _sections(lines: list[str], language: str):
    """``(head, [(heading, lines)])``; a heading stands alone at the outer indent."""
    head, found = [], []
    for line in lines:
        word = line.strip()
        is_heading = (word.startswith("# ") if language == "rust" else re.fullmatch(r"[A-Z][a-z]+:" if language == "python" else r"[^\s：-]+：", word)) and not line.startswith((" ", "\t"))
        if is_heading:
            found.append((word, []))
        elif found:
            found[-1][1].append(line)
        else:
            head.append(line)
    return head, found


def _fields(lines: list[str], language: str):
    """``(identity, column of the description, description)`` of each field line; ``None`` for a line without the delimiter."""
    out = []
    for line in lines:
        if not line.strip():
            continue
        m = re.match(r"(\s*)([^\s:]+):( +)(\S.*)$" if language == "python" else r"(\s*)- ([^\s：]+)：( +|)(\S.*)$", line)
        if m:
            out.append((m[2], len(m[1]) + len(m[2]) + 1 + len(m[3]), m[4], len(m[1])))
        elif out and len(line) - len(line.lstrip()) > out[-1][3]:
            continue
        else:
            out.append((None, 0, line, 0))
    return out


def _aligned(fields) -> bool:
    indents = {f[3] for f in fields}
    widest = max(len(f[0]) for f in fields)
    return len(indents) == 1 and all(f[1] - f[3] == widest + 2 for f in fields)


def judge(language: str, kind: str, tier: str, doc: str | None, params: list[str], shape: str | None, template: list[str] | None = None, effect: bool = False, unsafe: bool = False) -> list[str]:
    """Rules that a documentation subject violates, in catalogue order; a missing carrier is the only finding of its subject."""
    if kind == "module_docstring":
        return ["documentation.carrier"]
    if doc is None:
        return ["documentation.carrier"]
    out = []
    if language == "python":
        if not (doc.startswith("\n") and doc.rstrip(" \t").endswith("\n")):
            out.append("documentation.carrier")
        import inspect

        lines = inspect.cleandoc(doc).split("\n")
    else:
        lines = doc.strip("\n").split("\n")
    masked = prose.mask(lines, language)
    summary = lines[0].strip() if lines else ""
    if not _CJK_PAIR.search(masked[0] if masked else "") or summary in _ALL[language]:
        out.append("documentation.summary")
    head, sections = _sections(lines, language)
    if kind == "callable" and tier == "public" and not _contract_ok(language, head, sections, params, shape, template or [], effect, unsafe):
        out.append("documentation.public_contract")
    if any(prose.STOP.search(x) for x in masked):
        out.append("documentation.punctuation")
    if any(prose.PARENTHESES.search(x) for x in masked):
        out.append("documentation.parentheses")
    if language == "rust" and unsafe and not any(h == "# Safety" and "".join(prose.mask(body, language)).strip() for h, body in sections):
        out.append("documentation.safety")
    return out


def _contract_ok(language, head, sections, params, shape, template, effect, unsafe) -> bool:
    headings = [h for h, _ in sections]
    wanted = required_headings(language, bool(template), effect, unsafe)
    if [h for h in headings if h != "# Panics"] != list(wanted) or headings.count("# Panics") > 1:
        return False
    if "# Panics" in headings and headings.index("# Panics") != 3:
        return False
    if len(head) < 2 or head[1].strip() or (len(head) > 2 and not head[2].strip() and any(x.strip() for x in head[2:])):
        return False
    for heading, body in sections:
        content = [x for x in body if x.strip()]
        if not content:
            return False
        text = content[0].strip()
        empty = len(content) == 1 and text == EMPTY[language]
        if heading in ("Args:", "# Arguments", "参数：", "模板参数："):
            names = template if heading == "模板参数：" else params
            if not names:
                if not empty:
                    return False
                continue
            fields = _fields(content, language)
            if any(f[0] is None for f in fields) or sorted(f[0] for f in fields) != sorted(names) or not _aligned(fields):
                return False
        elif heading in ("Returns:", "# Returns", "返回："):
            if shape == "NoValue" and not empty:
                return False
            if shape == "Value" and (empty or text in ("None", "- ")):
                return False
            if shape == "Never" and not (language == "rust" and len(content) == 1 and text == NEVER_RETURNS):
                return False
        elif text == "None" or (heading == "效果：" and empty):
            return False
    return True
