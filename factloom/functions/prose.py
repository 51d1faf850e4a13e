"""Comment prose: masking of code inside prose, sentence stops, parentheses, allowed end-of-line directives, escapes of the human report."""

from __future__ import annotations

import re
import unicodedata

#: Characters of an allowed code in a directive, and the directives by language.
_CODES = r"[A-Za-z0-9_.-]+(?:\s*,\s*[A-Za-z0-9_.-]+)*"
_DIRECTIVES = {
    "python": re.compile(rf"pragma: no cover|fmt: skip|type: ignore(?:\[{_CODES}\])?|pyright: ignore(?:\[{_CODES}\])?|noqa(?:: {_CODES})?"),
    "rust": None,
    "c": re.compile(rf"IWYU pragma: keep|NOLINT(?:\({_CODES}\))?"),
    "cpp": re.compile(rf"IWYU pragma: keep|NOLINT(?:\({_CODES}\))?"),
}
_TICKS = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_TARGET = re.compile(r"(\[[^\]\n]*\])\([^()\n]*\)")
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
STOP = re.compile(r"。|(?<![\s.])\.(?=[\s\"'”’)\]]*(?:\s|$))(?!\.)")
PARENTHESES = re.compile(r"[()（）]")


def is_directive(body: str, language: str) -> bool:
    """Whether the whole body of a comment is a directive that may follow code."""
    allowed = _DIRECTIVES.get(language)
    return bool(allowed and allowed.fullmatch(body.strip()))


def mask(lines: list[str], language: str) -> list[str]:
    """The natural-language part of each line: fenced blocks, paired back-ticks, link targets and (Rust) indented code are blank."""
    out, fence, blank = [], None, True
    for line in lines:
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
            out.append("")
            continue
        if m and not (m[1][0] == "`" and "`" in line.strip()[len(m[1]) :]):
            fence = m[1]
            out.append("")
            continue
        indented = language == "rust" and blank and line.startswith(("    ", "\t"))
        out.append("" if indented else line)
        blank = indented or not line.strip()
    text = _TICKS.sub(lambda t: re.sub(r"[^\n]", " ", t[0]), "\n".join(out))
    return _TARGET.sub(r"\1", text).split("\n")


def escape_debug(text: str) -> str:
    """Quotes, backslashes, controls and separators written as escapes; printable characters stay."""
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0", "\\": "\\\\", '"': '\\"', "'": "\\'"}
    out = []
    for k, c in enumerate(text):
        category = unicodedata.category(c)
        grapheme = category in ("Mn", "Me") and k == 0
        out.append(short.get(c) or (f"\\u{{{ord(c):x}}}" if category in ("Cc", "Cf", "Cn", "Co", "Cs", "Zl", "Zp") or (category == "Zs" and c != " ") or grapheme else c))
    return "".join(out)


def natural_key(name: str) -> tuple:
    """Sort key in which digit runs compare by value; equal values keep the order of their spellings."""
    parts = re.findall(r"\d+|\D+", name)
    return tuple((0, len(p.lstrip("0")), p.lstrip("0"), "") if p.isdigit() else (1, 0, p, "") for p in parts), name
