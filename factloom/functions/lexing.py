"""Whole-file lexers for Python, Rust, C and C++.

Every lexer is one compiled alternation per language, run by ``findall`` / ``finditer`` so that the per-token work stays inside the
regular-expression engine.  Nothing here imports Spark: the functions are shipped to Python workers and called once per file.
"""

from __future__ import annotations

import re

#: File extensions of the managed languages (``.h`` is decided by the header facts, C when unlisted).
EXTENSION_LANGUAGE = {
    "py": "python", "rs": "rust", "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
}

_NUMBER = r"\.?\d(?:[eEpP][+-]|'(?=\w)|[\w.])*"
_IDENT = r"[^\W\d]\w*"

#: C family: comments, directives (with continuation lines and embedded block comments), literals, words, operators.
_C_COMMENT = r"//(?:[^\n\\]|\\(?:\r?\n|.)|\\$)*|/\*[\s\S]*?\*/"
_C_STRING = r'(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:\r?\n|.))*+"'
_C_CHAR = r"(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+'"
_C_RAW = r'(?:u8|[uUL])?R"([^()\\\s"]{0,16})\([\s\S]*?\)\1"'
_C_DIRECTIVE = r"(?:#(?!#)(?:[^\n\\/\"']|\\(?:\r?\n|.)|/\*[\s\S]*?\*/|/(?![/*])|\"(?:[^\"\\\n]|\\(?:\r?\n|.))*+\"|'(?:[^'\\\n]|\\.)+'|[\"'])*+)"
_C_OPERATOR = r"->\*?|\+\+|--|<<=|>>=|<=>|<=|>=|[-+*/%&|^!=]=|&&|\|\||::|\.\.\.|##"
#: Words come first because they are the most frequent; the look-ahead leaves literal prefixes to the literals.
_WORD_FIRST = r"[^\W\d]\w*+(?![\"'#])"


def _token(*alternatives: str, blank: str = r"\s*") -> re.Pattern:
    return re.compile(rf"{blank}({'|'.join(alternatives)})")


C_TOKEN = _token(_WORD_FIRST, _C_COMMENT, _C_DIRECTIVE, _C_STRING, _C_CHAR, _NUMBER, _IDENT, _C_OPERATOR, r"[^\s]", blank=r"(?:\s|\\\r?\n)*")
_C_RAW_SCAN = re.compile("|".join((_C_COMMENT, _C_RAW, _C_STRING, _C_CHAR)))

_RUST_BLOCK0 = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/"
_RUST_BLOCK1 = rf"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{_RUST_BLOCK0})*+\*/"
_RUST_BLOCK2 = rf"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{_RUST_BLOCK1})*+\*/"
_RUST_COMMENT = rf"//[^\n]*|{_RUST_BLOCK2}"
_RUST_RAW = r'[bc]?r"[^"]*"|[bc]?r#"[\s\S]*?"#|[bc]?r##"[\s\S]*?"##|[bc]?r###"[\s\S]*?"###'
_RUST_STRING = r'[bc]?"(?:[^"\\]|\\[\s\S])*+"'
_RUST_CHAR = r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}']*\}|.))'"
_RUST_NUMBER = r"\d\w*\.(?![\w.])|\d\w*(?:\.\d\w*)?(?:(?<=[eE])[+-]\d\w*)?"
_RUST_OPERATOR = r"->|=>|::|\.\.=|\.\.\.|\.\.|<=|>=|[-+*/%&|^!=]=|&&|\|\|"
RUST_TOKEN = _token(_WORD_FIRST, _RUST_COMMENT, _RUST_RAW, _RUST_STRING, _RUST_CHAR, r"'[^\W\d]\w*", r"r#" + _IDENT, _RUST_NUMBER, _IDENT, _RUST_OPERATOR, r"[^\s]")

_PY_PREFIX = r"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?"
_PY_STRING = (
    rf'{_PY_PREFIX}"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|{_PY_PREFIX}\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*+\'\'\''
    rf'|{_PY_PREFIX}"(?:[^"\\\n]|\\[\s\S])*+"|{_PY_PREFIX}\'(?:[^\'\\\n]|\\[\s\S])*+\''
)
PYTHON_TOKEN = _token(*(r"#[^\n]*", _PY_STRING, _NUMBER, _IDENT, r"\*\*=?|//=?|->|:=|[-+*/%&|^!=<>@]=|<<=?|>>=?|\.\.\.", r"[^\s]"))

TOKEN = {"python": PYTHON_TOKEN, "rust": RUST_TOKEN, "c": C_TOKEN, "cpp": C_TOKEN}

#: Comments and string literals only; everything else is skipped in the engine.  Character literals are matched so that their quotes
#: cannot open a string.
_RUST_SPAN = re.compile("|".join((rf"(?P<c>{_RUST_COMMENT})", rf"(?P<s>(?<!\w)(?:{_RUST_RAW})|{_RUST_STRING})", _RUST_CHAR)))
_C_SPAN = re.compile("|".join((rf"(?P<c>{_C_COMMENT})", rf"(?P<s>{_C_STRING})", r"(?<![0-9A-Fa-f])" + _C_CHAR)))
_PY_SPAN = re.compile("|".join((r"(?P<c>#[^\n]*)", rf"(?P<s>(?<!\w)(?:{_PY_STRING}))")))
SPAN = {"python": _PY_SPAN, "rust": _RUST_SPAN, "c": _C_SPAN, "cpp": _C_SPAN}


def flatten_raw_strings(text: str) -> str:
    """C++ raw strings become plain ones of equal length, so one alternation without groups can lex the file."""
    if 'R"' not in text:
        return text

    def plain(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        head = m[0].index('R"')
        body = m[0][head + 2 : -1]
        return m[0][:head] + ' "' + re.sub(r'["\\\n\r]', " ", body) + '"'

    return _C_RAW_SCAN.sub(plain, text)


_RUST_MARK = re.compile(r"/\*|\*/")
_RUST_OUTER = re.compile(rf"//[^\n]*|(?P<open>/\*)|(?<!\w)[bc]?r(?P<hash>#+)\"(?P<raw>[\s\S]*?)\"(?P=hash)|{_RUST_RAW}|{_RUST_STRING}|{_RUST_CHAR}")
_RUST_HASHES = re.compile(r'r####+"')


def _deep(text: str) -> bool:
    """Whether the marks of block comments ever stand deeper than the token expression nests."""
    depth = 0
    for m in _RUST_MARK.finditer(text):
        depth = depth + 1 if m[0] == "/*" else max(0, depth - 1)
        if depth > 3:
            return True
    return False


def flatten_rust(text: str) -> str:
    """Comments nested deeper and raw strings with more marks than the token expression knows become plain ones of equal length."""
    if not _RUST_HASHES.search(text) and (text.count("/*") < 4 or not _deep(text)):
        return text
    out, at = [], 0
    while m := _RUST_OUTER.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m["open"]:
            depth = 1
            while depth and (mark := _RUST_MARK.search(text, at)):
                depth += 1 if mark[0] == "/*" else -1
                at = mark.end()
            if depth:
                out.append(text[m.start() :])
                return "".join(out)
            out.append("/*" + _RUST_MARK.sub("  ", text[m.start() + 2 : at - 2]) + "*/")
        elif m["hash"] and len(m["hash"]) > 3:
            lead = m.start("hash") - m.start()
            out.append(" " * len(m["hash"]) + m[0][:lead] + '"' + m["raw"].replace('"', " ") + '"' + " " * len(m["hash"]))
        else:
            out.append(m[0])
    return "".join(out) + text[at:]


def flattened(text: str, language: str) -> str:
    """The text as the token expressions can lex it, of equal length."""
    return flatten_raw_strings(text) if language == "cpp" else flatten_rust(text) if language == "rust" else text


def language_of(path: str, header_profile: str | None) -> str | None:
    """Language a path stands for, or ``None`` for an unmanaged extension."""
    name = path.rpartition("/")[2]
    extension = name.rpartition(".")[2] if "." in name else ""
    if extension == "h":
        return "cpp" if header_profile == "cpp" else "c"
    return EXTENSION_LANGUAGE.get(extension)


_last: list = [None, []]


def tokens(text: str, language: str) -> list[str]:
    """All tokens, comments and directives included, in source order; not to be changed, as a header read as C and as C++ is lexed once."""
    if language not in ("c", "cpp"):
        return TOKEN[language].findall(flattened(text, language))
    if _last[0] != text or 'R"' in text:
        _last[:] = [text, TOKEN[language].findall(flattened(text, language))]
    return _last[1]


def spans(text: str, language: str):
    """Yield ``(kind, start, end)`` of each comment (``c``) and string literal (``s``)."""
    source = flattened(text, language)
    for m in SPAN[language].finditer(source):
        if m.lastgroup:
            yield m.lastgroup, m.start(), m.end()
