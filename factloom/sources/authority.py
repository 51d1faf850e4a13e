"""Project facts: strict admission of the JSON document before any source is read."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from factloom.functions.naming import RUST_KEYWORDS, is_root

SCHEMA_VERSION = 4
_FIELDS = {"schema_version", "public_callables", "token_vocabulary", "quantity_concepts", "header_languages", "external_fixed_identifiers", "dependency_authority"}
_DEPENDENCY = {"python_standard_library": [], "python_third_party": [], "python_project_roots": [], "python_reorder_safe": False, "rust_reorder_safe": False}
#: Keywords that some edition allows as the name of a lifetime.
_LIFETIMES = frozenset("static async await dyn try gen union".split())
_CONCEPT = re.compile(r"[a-z]+(?:_[a-z]+)*")
_SUFFIX = re.compile(r"[a-z]+\d*(?:_[a-z]+\d*)*")


class Rejection(Exception):
    """Inadmissible input, with its code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


@dataclass(frozen=True)
class Authority:
    """Admitted facts; every collection is sorted, so permutations of a document are equal."""

    public_callables: tuple[tuple[str, str], ...] = ()
    token_vocabulary: tuple[str, ...] = ()
    quantity_concepts: tuple[tuple[str, str], ...] = ()
    header_languages: tuple[tuple[str, str], ...] = ()
    external_fixed_identifiers: tuple[tuple[str, str, str, str], ...] = ()
    dependency_classes: tuple[tuple[str, str], ...] = ()
    python_reorder_safe: bool = False
    rust_reorder_safe: bool = False
    listed_paths: tuple[str, ...] = field(default=())

    def canonical(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True, ensure_ascii=False)


def normalise_path(path: str, code: str = "scope.path") -> str:
    """``/``-separated relative path; absolute, drive, empty, ``.`` and ``..`` segments are rejected."""
    out = path.replace("\\", "/")
    parts = out.split("/")
    if not out or out.startswith("/") or re.match(r"[A-Za-z]:", out) or any(p in ("", ".", "..") for p in parts):
        raise Rejection(code, f"path is not a normal relative path: {path}")
    return out


def _pairs(items):
    keys = [k for k, _ in items]
    if len(set(keys)) != len(keys):
        raise Rejection("authority.syntax", "duplicate key")
    return dict(items)


def _paths(value: dict) -> dict:
    out = {}
    for path, v in value.items():
        key = normalise_path(path, "authority.path")
        if key in out:
            raise Rejection("authority.path", f"paths collide after normalisation: {path}")
        out[key] = v
    return out


def _texts(value, name: str) -> list[str]:
    if not isinstance(value, list) or any(not isinstance(x, str) for x in value):
        raise Rejection("authority.syntax", f"{name} must be an array of strings")
    return value


def _quantities(concepts: dict) -> set[tuple[str, str]]:
    pairs: set[tuple[str, str]] = set()
    spelled: dict[str, str] = {}
    for concept, suffixes in concepts.items():
        own = _texts(suffixes, "quantity_concepts")
        if not _CONCEPT.fullmatch(concept) or not own or len(set(own)) != len(own) or any(not _SUFFIX.fullmatch(s) for s in own):
            raise Rejection("authority.quantity", f"concept or suffix is malformed: {concept}")
        for suffix in own:
            name = f"{concept}_{suffix}"
            if spelled.setdefault(name, concept) != concept or name in concepts:
                raise Rejection("authority.quantity", f"name has several decompositions: {name}")
            pairs.add((concept, suffix))
    return pairs


def _external(rows) -> set[tuple[str, str, str, str]]:
    out = set()
    for row in rows:
        if not isinstance(row, dict) or set(row) != {"profile", "role", "owner", "spelling"} or any(not isinstance(v, str) for v in row.values()):
            raise Rejection("authority.external_fixed", "entry must have profile, role, owner and spelling")
        spelling, owner = row["spelling"], row["owner"]
        raw = spelling.startswith("r#")
        word = spelling.removeprefix("r#")
        path = re.fullmatch(r"((?:r#)?\w+(?:::(?:r#)?\w+)*)(?:<'(\w+)>)?", owner)
        segments = path[1].split("::") if path else []
        bad = not word.isidentifier() or (raw and word in ("_", "crate", "self", "Self", "super")) or (not raw and word in RUST_KEYWORDS) or word == "_"
        bad_owner = not path or any((not s.startswith("r#") and s in RUST_KEYWORDS and not (k == 0 and len(segments) > 1 and s in ("crate", "self", "super", "Self"))) or not s.removeprefix("r#").isidentifier() or s == "_" for k, s in enumerate(segments))
        bad_owner = bad_owner or path[2] in RUST_KEYWORDS - _LIFETIMES
        if row["profile"] != "rust" or row["role"] != "function" or bad or bad_owner:
            raise Rejection("authority.external_fixed", f"entry is not an observable Rust function: {owner}::{spelling}")
        out.add((row["profile"], row["role"], owner, spelling))
    return out


def admit(raw: bytes | str) -> Authority:
    """Admit one document; missing fields are empty, unknown fields and duplicate keys are rejected."""
    try:
        document = json.loads(raw, object_pairs_hook=_pairs)
    except (ValueError, UnicodeDecodeError) as e:
        raise Rejection("authority.syntax", f"document is not valid JSON: {e}") from e
    if not isinstance(document, dict) or set(document) - _FIELDS:
        raise Rejection("authority.syntax", "unknown field")
    if document.get("schema_version") != SCHEMA_VERSION or isinstance(document.get("schema_version"), bool):
        raise Rejection("authority.version", f"schema_version must be {SCHEMA_VERSION}")
    maps = {k: document.get(k) or {} for k in ("public_callables", "quantity_concepts", "header_languages")}
    if any(not isinstance(v, dict) for v in maps.values()) or not isinstance(document.get("external_fixed_identifiers") or [], list):
        raise Rejection("authority.syntax", "field has the wrong type")
    callables, headers = _paths(maps["public_callables"]), _paths(maps["header_languages"])
    for path, profile in headers.items():
        if profile not in ("c", "cpp") or not path.endswith(".h"):
            raise Rejection("authority.header_language", f"header language must be c or cpp: {path}")
    dependency = document.get("dependency_authority") or {}
    if not isinstance(dependency, dict) or set(dependency) - set(_DEPENDENCY):
        raise Rejection("authority.syntax", "unknown dependency field")
    dependency = _DEPENDENCY | dependency
    classes: dict[str, str] = {}
    for name, kind in (("python_standard_library", "standard"), ("python_third_party", "third_party"), ("python_project_roots", "project")):
        for root in _texts(dependency[name], name):
            if not is_root(root) or root in classes:
                raise Rejection("authority.dependency", f"root is no identifier or listed twice: {root}")
            classes[root] = kind
    if not isinstance(dependency["python_reorder_safe"], bool) or not isinstance(dependency["rust_reorder_safe"], bool):
        raise Rejection("authority.syntax", "reorder flags must be boolean")
    return Authority(
        tuple(sorted({(p, n) for p, names in callables.items() for n in _texts(names, "public_callables")})),
        tuple(sorted({t.lower() for t in _texts(document.get("token_vocabulary") or [], "token_vocabulary")})),
        tuple(sorted(_quantities(maps["quantity_concepts"]))),
        tuple(sorted(headers.items())),
        tuple(sorted(_external(document.get("external_fixed_identifiers") or []))),
        tuple(sorted(classes.items())),
        dependency["python_reorder_safe"],
        dependency["rust_reorder_safe"],
        tuple(sorted(callables)),
    )


def read(directory: str) -> Authority:
    """Admit ``authority.json`` of a directory."""
    path = os.path.join(directory, "authority.json")
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except FileNotFoundError as e:
        raise Rejection("authority.read", f"{path} is missing; prepare the project facts first") from e
    except OSError as e:
        raise Rejection("authority.read", f"{path} cannot be read") from e
    return admit(raw)


def from_documents(documents: dict[str, bytes]) -> Authority:
    """Admit a set of in-memory documents by name (A4): exactly one, named ``authority.json``."""
    if list(documents) != ["authority.json"]:
        raise Rejection("authority.read", f"exactly one document named authority.json is needed, not {sorted(documents)}")
    return admit(documents["authority.json"])
