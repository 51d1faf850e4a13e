"""Names: native forms, tokens, case forms by role, reserved spellings."""

from __future__ import annotations

import keyword
import re

LOWER = r"[a-z][a-z0-9]*(?:_[a-z0-9]+)*"
UPPER = r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*"
PASCAL = r"(?:[A-Z][a-z0-9]*)+"

#: The form of each role by language; several forms are alternatives.
FORMS = {
    "python": {"variable": LOWER, "private": "_+" + LOWER, "type": PASCAL, "alias": f"{LOWER}|{PASCAL}", "module": f"{LOWER}|{UPPER}", "enum_member": UPPER, "constant": UPPER, "type_parameter": PASCAL, "function": LOWER, "type_alias": f"{PASCAL}|{LOWER}"},
    "rust": {"variable": LOWER, "function": LOWER, "type": PASCAL, "alias": f"{LOWER}|{PASCAL}|{UPPER}", "module": LOWER, "enum_member": PASCAL, "constant": UPPER, "macro": LOWER, "type_parameter": PASCAL, "const_parameter": UPPER, "lifetime": "'" + LOWER, "label": "'" + LOWER},
    "c": {"variable": LOWER, "function": LOWER, "tag": LOWER, "typedef": LOWER + "_t", "enum_member": UPPER, "constant": UPPER, "macro": UPPER, "label": LOWER},
    "cpp": {"variable": LOWER, "function": LOWER, "private_member": LOWER + "_", "type": PASCAL, "namespace": LOWER, "enum_member": UPPER, "constant": UPPER, "macro": UPPER, "type_parameter": PASCAL, "const_parameter": UPPER},
}
#: Rust keywords, which raw identifiers may spell except the last five.
RUST_KEYWORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while abstract become box do final macro override priv try typeof unsized virtual yield".split()
)


def bare(name: str, role: str, language: str) -> str:
    """The name without its native form."""
    if language == "python":
        return name.lstrip("_")
    if language == "rust":
        return name.removeprefix("r#").lstrip("'").lstrip("_")
    if language == "c" and role == "typedef":
        return name.removesuffix("_t")
    return name.rstrip("_") if language == "cpp" and role == "private_member" else name


def name_tokens(name: str) -> list[str]:
    """Words of a bare name: separated by underscores and by lower-to-upper changes."""
    return [t for part in name.split("_") for t in re.split(r"(?<=[^\W\d_A-Z])(?=[^\W\d_a-z])(?=\w)", part) if t] if name.isascii() else [t for part in name.split("_") for t in _unicode_words(part)]


def _unicode_words(part: str) -> list[str]:
    out, at = [], 0
    for k in range(1, len(part)):
        if part[k - 1].islower() and part[k].isupper():
            out.append(part[at:k])
            at = k
    return [w for w in [*out, part[at:]] if w]


def form_ok(name: str, role: str, language: str) -> bool:
    """Whether a spelling has the form of its role; unknown roles are not judged."""
    pattern = FORMS[language].get(role)
    if pattern is None:
        return True
    spelled = name.removeprefix("r#")
    if language == "python" and role in ("variable", "function", "module", "constant", "type", "type_parameter", "type_alias") and spelled.startswith("_"):
        if re.fullmatch(r"__\w+__", spelled):
            return True
        spelled = spelled.lstrip("_")
    if language == "rust" and spelled.startswith("_") and len(spelled) > 1:
        spelled = spelled.lstrip("_")
    if not re.fullmatch(pattern, spelled):
        return False
    body = bare(spelled, role, language).lower()
    if role in ("type", "type_parameter") or body != bare(spelled, role, language).lower():
        return True
    allowed, forbidden = "is|has|can|should|needs|lower|upper|minimum|maximum", "min|max"
    return not re.match(rf"(?:(?:{forbidden})_|(?:{allowed})_(?:{allowed}|{forbidden})_)", body)


def is_reserved(name: str, language: str) -> bool:
    """Spellings the language keeps for itself."""
    if language == "rust":
        return name.startswith("r#") and name[2:] in RUST_KEYWORDS
    if language in ("c", "cpp"):
        return bool(re.match(r"_(?:[A-Z_]|$)", name)) or (language == "cpp" and "__" in name) or name.startswith("_")
    return False


def is_root(name: str) -> bool:
    """A native Python identifier that may be an import root: soft keywords may, hard ones may not."""
    return name.isidentifier() and not keyword.iskeyword(name)
