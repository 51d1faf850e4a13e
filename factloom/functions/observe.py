"""Facts of one source file: comments, names, documentation subjects, imports and the gaps that block a family.

``observe`` lexes and parses a file once and yields flat fact tuples, so that every rule is a filter or a join over one table.
"""

from __future__ import annotations

import ast
import bisect
import json
import re
import warnings

from factloom.functions import prose
from factloom.functions.declarations import CReader, Declared, RustReader, Tokens, doc_attributes
from factloom.functions.grammar import analyse, damage_offset
from factloom.functions.lexing import TOKEN
from factloom.functions.prose import natural_key

FIELDS = ("fact", "line", "column_no", "subject", "role", "body", "detail")


def _positions(text: str):
    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())

    def at(offset: int) -> tuple[int, int]:
        k = bisect.bisect_right(starts, offset) - 1
        return k + 1, len(text[starts[k] : offset].encode("utf-8")) + 1

    return at


def _fact(fact, position, subject="", role="", body="", **detail):
    return fact, position[0], position[1], subject, role, body, json.dumps(detail, ensure_ascii=False, sort_keys=True) if detail else None


_MARK = {"python": re.compile(r"#+!?\s?"), "other": re.compile(r"//+!?[ \t]?|/\*+[ \t]?")}


def _comments(tokens, at, language: str, docs: set[int]):
    """Ordinary comments: trailing ones, and each line of their masked prose."""
    last_code, run = None, []

    def flush():
        if run:
            for (line, column), body in zip([r[0] for r in run], prose.mask([r[1] for r in run], language)):
                if body.strip():
                    yield _fact("prose", (line, column), body=body)
            run.clear()

    for token, start, end in tokens:
        is_comment = token.startswith("#") if language == "python" else token.startswith(("//", "/*"))
        if not is_comment:
            if run:
                yield from flush()
            last_code = max(start, end - 1)
            continue
        if start in docs:
            continue
        line, column = at(start)
        body = _MARK["python" if language == "python" else "other"].sub("", token, count=1)
        body = re.sub(r"\*+/$", "", body) if token.startswith("/*") else body
        if last_code is not None and at(last_code)[0] == line:
            yield from flush()
            if not prose.is_directive(body, language):
                yield _fact("trailing", (line, column), body=body.strip())
                run.extend(((line + k, column if not k else 1), x) for k, x in enumerate(body.split("\n")))
                yield from flush()
        else:
            if run and run[-1][0][0] != line - 1:
                yield from flush()
            run.extend(((line + k, column if not k else 1), re.sub(r"^\s*\*\s?", "", x) if k else x) for k, x in enumerate(body.split("\n")))
    yield from flush()


# ---------------------------------------------------------------------------------------------------------------- Python


#: Annotations of functions that never return.
_NEVER = frozenset(("Never", "NoReturn", "typing.Never", "typing.NoReturn"))


_NATIVE_MODULES = ("enum", "typing", "ctypes", "builtins")
_BUILTIN_DECORATORS = ("staticmethod", "classmethod", "property")
_PLAIN_METHODS = ("enum.nonmember", *(f"builtins.{d}" for d in _BUILTIN_DECORATORS))
#: Methods that take the class without being told so.
_CLASS_METHODS = ("__init_subclass__", "__class_getitem__", "__new__")


def _rebound(tree: ast.Module) -> set[str]:
    """Names that the module's own statements bind other than by importing, branches included; an attribute set on a name counts as well."""
    out: set[str] = set()
    stack: list = list(tree.body)
    while stack:
        node = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.add(node.name)
            continue
        if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.For, ast.AsyncFor)):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                for x in ast.walk(t):
                    if isinstance(x, ast.Name):
                        out.add(x.id)
        for field in ("body", "orelse", "finalbody", "handlers", "cases"):
            stack.extend(getattr(node, field, None) or () if isinstance(getattr(node, field, None), list) else ())
    return out


def _python(text: str, at):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines = text.split("\n")
    natives: dict[str, str] = {}
    for node in tree.body:
        if isinstance(node, ast.ImportFrom) and node.module in _NATIVE_MODULES and not node.level:
            natives |= {a.asname or a.name: f"{node.module}.{a.name}" for a in node.names}
        elif isinstance(node, ast.Import):
            natives |= {a.asname or a.name: a.name for a in node.names if a.name in _NATIVE_MODULES}
    imported = {a.asname or a.name.split(".")[0] for node in ast.walk(tree) if isinstance(node, (ast.Import, ast.ImportFrom)) for a in node.names}
    shadowed = _rebound(tree)
    for name in shadowed:
        natives.pop(name, None)

    def native(node) -> str:
        if isinstance(node, ast.Call):
            node = node.func
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            return f"{natives.get(node.value.id, '')}.{node.attr}"
        if not isinstance(node, ast.Name):
            return ""
        own = natives.get(node.id, "")
        return own or (f"builtins.{node.id}" if node.id in _BUILTIN_DECORATORS and node.id not in shadowed and node.id not in imported else "")

    def where(node, name=None):
        column = node.col_offset
        line = node.lineno
        if name is not None:
            source = lines[line - 1].encode()
            column = _word_at(source, name.encode(), column)
        return line, column + 1

    out = []

    def name(node, spelled, role):
        out.append(_fact("name", where(node, spelled), spelled, role))

    def target(node, role="variable", scope="module"):
        if isinstance(node, ast.Name):
            constant = scope == "module" and node.id.isupper() and role == "variable"
            if (node.id == "__all__" and scope == "module") or (node.id == "__slots__" and scope == "class"):
                return
            name(node, node.id, "constant" if constant and "_" in node.id + "_" and len(node.id) > 1 else role)
        elif isinstance(node, (ast.Tuple, ast.List)):
            for x in node.elts:
                target(x, role, scope)
        elif isinstance(node, ast.Starred):
            target(node.value, role, scope)
        elif isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self":
            name(node, node.attr, "variable")

    enums = {"enum.Enum", "enum.IntEnum", "enum.StrEnum", "enum.Flag", "enum.IntFlag"}

    def visit(node, scope, owner=None, nested=False):
        for child in ast.iter_child_nodes(node):
            inner, kind, below = scope, owner, nested
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                method_role(child, scope, owner)
                inner, below = "function", True
                function(child, scope, nested)
                kind = None
            elif isinstance(child, ast.Lambda):
                for a in _arguments(child.args):
                    name(a, a.arg, "variable")
            elif isinstance(child, ast.ClassDef):
                name(child, child.name, "type")
                bases = {native(b) for b in child.bases}
                inner, kind = "class", "enum" if bases & enums else "ctypes" if bases & {"ctypes.Structure", "ctypes.Union"} else "class"
                subject(child, child.name, "internal", "class", [], None)
            elif isinstance(child, ast.Assign):
                factory = native(child.value) if isinstance(child.value, ast.Call) else ""
                for t in child.targets:
                    if scope == "class" and owner == "enum" and isinstance(t, ast.Name):
                        if t.id in ("_ignore_", "_order_"):
                            if t.id == "_ignore_" and not isinstance(child.value, (ast.Constant, ast.List, ast.Tuple)):
                                out.append(_fact("gap", where(t), t.id, "identifier", body="enum member role is unresolved"))
                            continue
                        if isinstance(child.value, (ast.Constant, ast.Tuple)) or factory in ("enum.auto", "enum.member"):
                            name(t, t.id, "enum_member")
                        elif factory == "enum.nonmember":
                            name(t, t.id, "variable")
                        else:
                            out.append(_fact("gap", where(t), t.id, "identifier", body="enum member role is unresolved"))
                        continue
                    if owner == "ctypes" and isinstance(t, ast.Name) and t.id == "_fields_":
                        continue
                    target(t, "type_parameter" if factory in ("typing.TypeVar", "typing.ParamSpec", "typing.TypeVarTuple") else "variable", scope)
            elif isinstance(child, ast.AnnAssign):
                target(child.target, "type_alias" if native(child.annotation) == "typing.TypeAlias" else "variable", scope)
            elif isinstance(child, (ast.For, ast.AsyncFor, ast.comprehension)):
                target(child.target, "variable", "function")
            elif isinstance(child, ast.NamedExpr):
                target(child.target, "variable", "function")
            elif isinstance(child, ast.withitem) and child.optional_vars is not None:
                target(child.optional_vars, "variable", "function")
            elif isinstance(child, ast.ExceptHandler) and child.name:
                name(child, child.name, "variable")
            elif isinstance(child, (ast.MatchAs, ast.MatchStar)) and child.name:
                name(child, child.name, "variable")
            elif isinstance(child, ast.MatchMapping) and child.rest:
                name(child, child.rest, "variable")
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                for a in child.names:
                    if a.asname:
                        name(a, a.asname, "alias")
            elif isinstance(child, (ast.Global, ast.Nonlocal)):
                continue
            elif hasattr(ast, "TypeAlias") and isinstance(child, ast.TypeAlias):
                name(child.name, child.name.id, "type")
            elif hasattr(ast, "TypeVar") and isinstance(child, (ast.TypeVar, ast.ParamSpec, ast.TypeVarTuple)):
                name(child, child.name, "type_parameter")
            visit(child, inner, kind if inner == scope or inner == "class" else None, below)

    def method_role(node, scope, owner):
        """A decorated member of an enumeration is a member where ``enum.member`` says so; other decorators must be known."""
        decorators = [native(d) for d in node.decorator_list]
        if scope == "class" and owner == "enum" and "enum.member" in decorators and len(decorators) == 1:
            name(node, node.name, "enum_member")
        elif scope == "class" and owner == "enum" and any(d not in _PLAIN_METHODS for d in decorators):
            out.append(_fact("gap", where(node, node.name), node.name, "identifier", body="enum member role is unresolved"))
        else:
            name(node, node.name, "function")

    def function(node, scope, nested):
        arguments = _arguments(node.args)
        decorators = {native(d) for d in node.decorator_list}
        static = "builtins.staticmethod" in decorators
        takes_class = not static and ("builtins.classmethod" in decorators or node.name in _CLASS_METHODS)
        receiver = scope == "class" and bool(arguments) and not static and arguments[0].arg == ("cls" if takes_class else "self")
        for k, a in enumerate(arguments):
            name(a, a.arg, "receiver" if receiver and not k else "variable")
        declared = [a.arg for a in arguments[1 if receiver else 0 :]]
        returns = node.returns
        text_of = ast.unparse(returns) if returns is not None else None
        shape = "Unknown" if text_of is None else "NoValue" if text_of == "None" else "Never" if native(returns) in ("typing.Never", "typing.NoReturn") or text_of in _NEVER else "Value"
        public = not nested and (not node.name.startswith("_") or re.fullmatch(r"__\w+__", node.name) is not None)
        subject(node, node.name, "public" if public else "internal", "callable", declared, shape)

    def subject(node, spelled, tier, kind, params, shape):
        first = node.body[0] if node.body else None
        has = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
        at_doc = (first.lineno, first.col_offset + 1) if has else None
        raw = first.value.value if has else None
        out.append(_fact("subject", where(node, spelled), spelled, kind, tier=tier, params=params, shape=shape, doc=raw, doc_at=at_doc))

    if tree.body and isinstance(tree.body[0], ast.Expr) and isinstance(tree.body[0].value, ast.Constant) and isinstance(tree.body[0].value.value, str):
        out.append(_fact("subject", (tree.body[0].lineno, 1), "<module>", "module_docstring", doc=tree.body[0].value.value, tier="internal"))
    visit(tree, "module")
    out += _python_imports(tree)
    return out


_WORD_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _word_at(line: bytes, word: bytes, start: int) -> int:
    """Where the whole word stands in a line from ``start`` on; ``start`` itself when it stands nowhere."""
    at = line.find(word, start)
    while at >= 0:
        end = at + len(word)
        if (not at or line[at - 1] not in _WORD_BYTES) and (end >= len(line) or line[end] not in _WORD_BYTES):
            return at
        at = line.find(word, at + 1)
    return start


def _arguments(args: ast.arguments) -> list[ast.arg]:
    return [*args.posonlyargs, *args.args, *([args.vararg] if args.vararg else []), *args.kwonlyargs, *([args.kwarg] if args.kwarg else [])]


def _python_imports(tree):
    """One fact per imported item with its group: groups are runs of import statements within a block."""
    out, group, statement = [], 0, 0
    for node in ast.walk(tree):
        for field in ("body", "orelse", "finalbody"):
            block = getattr(node, field, None)
            if not isinstance(block, list):
                continue
            group += 1
            for child in block:
                future = isinstance(child, ast.ImportFrom) and child.module == "__future__"
                if not isinstance(child, (ast.Import, ast.ImportFrom)):
                    group += 1
                    continue
                if future:
                    group += 1
                statement += 1
                modules = [a.name for a in child.names] if isinstance(child, ast.Import) else ["." * child.level + (child.module or "")]
                wild = isinstance(child, ast.ImportFrom) and any(a.name == "*" for a in child.names)
                for item, module in enumerate(modules):
                    position = (child.lineno, child.col_offset + 1)
                    if isinstance(child, ast.Import):
                        position = (child.names[item].lineno, child.names[item].col_offset + 1)
                    root = "" if module.startswith(".") else module.split(".")[0]
                    out.append(_fact("import", position, module, "future" if future else "relative" if not root else "root", body=root, group=group, statement=statement, item=item, end=child.end_lineno, start=child.lineno))
                if wild:
                    out.append(_fact("wildcard", (child.lineno, child.col_offset + 1), modules[0]))
                if future:
                    group += 1
    return out


# -------------------------------------------------------------------------------------------------- Rust, C and C++


#: Stands for documentation whose text the source does not hold, such as ``#[doc = include_str!(...)]``.
UNREAD = object()


def _doc_text(token: str) -> str:
    if token.startswith("///"):
        return token[3:].removeprefix(" ")
    return "\n".join(re.sub(r"^\s*\*?\s?", "", x) if k else x.strip() for k, x in enumerate(token[3:-2].split("\n"))).strip("\n ")


def _carrier(token: str, rust: bool) -> bool:
    """Whether a comment is native documentation of what stands behind it."""
    if rust and token.startswith("///"):
        return not token.startswith("////")
    return token.startswith("/**") and token[3:4] not in ("*", "/") and (rust or token[3:4] != "<")


class _Carriers:
    """Comments and documentation attributes of a file, to be attached to declarations."""

    def __init__(self, text: str, tokens: Tokens, rust: bool):
        self.text, self.rust = text, rust
        rows = [(a, b, "inner" if rust and w[:3] in ("//!", "/*!") else "doc" if _carrier(w, rust) else "note", w) for w, a, b in tokens.comments]
        rows += [(a, b, "doc" if body is not None else "unread", body) for a, b, body in doc_attributes(tokens)] if rust else []
        self.rows = sorted(rows, key=lambda r: r[0])
        self.starts = [r[0] for r in self.rows]
        self.used: set[int] = set()

    def _body(self, row):
        start, _, kind, text = row
        return UNREAD if kind == "unread" else _doc_text(text) if self.text.startswith(("//", "/*"), start) else text

    def of(self, begin: int, head: int):
        """Documentation of the declaration that begins at ``begin``; attributes reach up to ``head``."""
        parts, edge = [], begin
        for row in self.rows[bisect.bisect_left(self.starts, begin) : bisect.bisect_left(self.starts, head)]:
            if row[2] in ("doc", "unread"):
                parts.append(self._body(row))
                self.used.add(row[0])
            elif row[2] == "inner":
                parts = []
        k = bisect.bisect_left(self.starts, begin) - 1
        while k >= 0:
            row = self.rows[k]
            if self.text[row[1] : edge].strip() or row[2] == "inner" or (row[2] == "note" and not self.rust):
                break
            if row[2] != "note":
                parts.insert(0, self._body(row))
                self.used.add(row[0])
                if not self.rust:
                    break
            edge = row[0]
            k -= 1
        if any(p is UNREAD for p in parts):
            return UNREAD
        return "\n".join(parts) if parts else None


def _subject_fact(at, s: Declared, carriers: _Carriers, tier: str):
    doc = carriers.of(s.begin, max(s.head, s.begin))
    extra = {"unread": True} if doc is UNREAD else {}
    extra |= {"effect": True} if s.effect else {}
    extra |= {"partial": True} if s.partial else {}
    callable_ = s.kind == "callable"
    return _fact("subject", at(s.at), s.name, s.kind, tier=tier, params=s.params, shape=s.shape if callable_ else None, doc=None if doc is UNREAD else doc, unsafe=s.unsafe, template=s.template, **extra)


def _rust(text: str, at, tokens: Tokens):
    reader = RustReader(text, tokens)
    carriers = _Carriers(text, tokens, True)
    owners = {s.at: s.owner for s in reader.subjects if s.owner}
    out = [_fact("name", at(k), spelled, role, **({"owner": owners[k]} if k in owners else {})) for k, spelled, role in reader.names]
    # a lifetime or label counts where it is declared; the same subject's documentation is read once
    for s in reader.subjects:
        out.append(_subject_fact(at, s, carriers, s.tier))
    return out + _rust_uses(reader, at), carriers.used


_SEGMENT_RANK = {"self": 0, "super": 1, "crate": 2}
_BINDING, _FURTHER, _WILDCARD, _LIST = range(4)


def _use_tree(reader: RustReader, k: int, end: int, at, out: list, whole: tuple | None):
    """Sort key of the use tree in a token range, ``None`` when a part of it is unknown; members out of order and wildcards become facts."""
    t, key, begin = reader.t, [], k
    if t.get(k) == "::":
        key.append((_FURTHER, 3, ((), "")))
        k += 1
    while k < end:
        w = t.word[k]
        if w == "*":
            out.append(_fact("wildcard", at(t.start[k]), "".join(t.word[begin:end])))
            return (*key, (_WILDCARD,))
        if w == "{":
            members, j, before = [], k + 1, None
            while j < t.pair[k]:
                stop = t.until(j, t.pair[k], frozenset(","))
                member = _use_tree(reader, j, stop, at, out, None)
                if member is not None and before is not None and before > member:
                    out.append(_fact("misorder", at(t.start[j]), "".join(t.word[j:stop]), "rust"))
                before = member
                members.append(member)
                j = stop + 1
            return None if None in members else (*key, (_LIST, *members))
        if not (w.isidentifier() or w.startswith("r#")):
            out.append(_fact("gap", whole or at(t.start[begin]), "".join(t.word[begin:end]), "dependency_declaration", body="use tree is unsupported"))
            return None
        name = w.removeprefix("r#")
        key.append((_FURTHER, _SEGMENT_RANK.get(w, 3), natural_key(name)))
        k += 1
        if t.get(k) == "as" and k < end:
            return (*key, (_BINDING, t.get(k + 1).removeprefix("r#")))
        if k < end and t.word[k] == "::":
            k += 1
    return (*key, (_BINDING, ""))


def _rust_uses(reader: RustReader, at):
    """Use declarations, their wildcards and unknown members, and neighbours out of order in one group: the same block, no line between."""
    out, before, t = [], None, reader.t
    for offset, k, stop, block in reader.uses:
        spelled = "".join(t.word[k:stop])
        out.append(_fact("import", at(offset), spelled, "use", group=0, statement=offset, item=0))
        whole = at(offset) if t.get(k) == "$" else None
        key = _use_tree(reader, k, stop, at, out, whole)
        if before is not None and before[0] == block and before[2] is not None and key is not None:
            between = reader.t.text[before[1] : offset]
            if not re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", "", between).strip() and not re.search(r"\n[ \t\r]*\n", between) and before[2] > key:
                out.append(_fact("misorder", at(offset), spelled, "rust"))
        before = (block, t.stop[min(stop, len(t.stop) - 1)], key)
    return out


def _c(text: str, at, language: str, tokens: Tokens):
    reader = CReader(text, language, tokens)
    carriers = _Carriers(text, tokens, False)
    out = [_fact("name", at(k), spelled, role) for k, spelled, role in reader.names]
    out += [_subject_fact(at, s, carriers, s.tier) for s in reader.subjects]
    includes = [(a, " ".join(w.split())) for w, a, _ in tokens.directives if re.match(r"\s*#\s*include\b", w)]
    word = tokens.word
    for k, w in enumerate(word):
        first = k - 1 if k and word[k - 1] == "export" else k
        if language == "cpp" and w == "import" and (first == 0 or word[first - 1] in (";", "{", "}")) and (tokens.get(k + 1)[:1] in '<":' or tokens.get(k + 1).isidentifier()) and tokens.get(k + 1):
            includes.append((tokens.start[first], " ".join(word[first : tokens.until(k, len(word), frozenset(";"))])))
    out += [_fact("import", at(a), spelled, "include", group=0, statement=a, item=0) for a, spelled in sorted(includes)]
    if language == "cpp":
        out += _module_placement(tokens, at)
    return out, carriers.used


_CONDITION = re.compile(r"\s*#\s*(\w+)")


def _module_placement(tokens: Tokens, at):
    """Module imports that are misplaced on every preprocessor path.

    A path's state is (an ordinary declaration was seen, the global fragment is open); conditions split the set of possible states, and what
    follows a condition may be reached from the end of each branch, or past it where no branch is sure to be taken.
    """
    out, states, stack, depth = [], {(False, False)}, [], 0
    statement: list[tuple[str, int]] = []

    def flush():
        nonlocal states
        words = [w for w, _ in statement]
        if not words:
            return
        bare = words[1:] if words[0] == "export" else words
        if depth == 0 and bare == ["module"]:
            states = {(False, True)}
        elif depth == 0 and bare[:2] == ["module", ":"]:
            states = {(True, fragment) for _, fragment in states}
        elif depth == 0 and bare[:1] == ["module"] and len(bare) > 1 and bare[1].isidentifier():
            states = {(False, False)}
        elif bare[:1] == ["import"] and len(bare) > 1 and (bare[1][0] in '<":' or bare[1].isidentifier()):
            if depth or all(closed or fragment for closed, fragment in states):
                out.append(_fact("misplaced", at(statement[0][1]), " ".join(words)))
        else:
            states = {(True, fragment) for _, fragment in states}
        statement.clear()

    for w, start, _ in sorted([*tokens.directives, *zip(tokens.word, tokens.start, tokens.stop)], key=lambda t: t[1]):
        condition = _CONDITION.match(w) if w.lstrip()[:1] == "#" else None
        if condition:
            kind = condition[1]
            if kind in ("if", "ifdef", "ifndef"):
                stack.append((states, set(), False))
            elif kind[:2] == "el" and stack:
                before, ends, _ = stack[-1]
                stack[-1] = (before, ends | states, kind == "else")
                states = before
            elif kind == "endif" and stack:
                before, ends, complete = stack.pop()
                states = ends | states | (set() if complete else before)
        elif w == ";":
            flush()
        elif w in "{}":
            if statement:
                flush()
            depth += 1 if w == "{" else -1
        else:
            statement.append((w, start))
    return out


def observe(content: bytes | None, language: str) -> list[tuple]:
    """All facts of one file; a damaged one gives its line count and one ``damage`` fact with the reason and position."""
    data = content or b""
    lines = data.count(b"\n") + (1 if data and not data.endswith(b"\n") else 0)
    facts = [_fact("lines", (lines, 0))]
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        head = data[: e.start]
        return [*facts, _fact("damage", (head.count(b"\n") + 1, e.start - head.rfind(b"\n")), role="encoding", body="source is not valid UTF-8")]
    read: list[Tokens] = []

    def lexer(text, language):
        read.append(Tokens(text, language))
        return read[0].lexed

    problem, text, _ = analyse(data, language, lex_python=False, lexer=lexer, words=False)
    at = _positions(text)
    if problem:
        position = (1, 1)
        if language == "python":
            problem = analyse(data, language, lex_python=False)[0] or problem
            try:
                ast.parse(text)
            except SyntaxError as e:
                position = (e.lineno or 1, e.offset or 1)
            except (ValueError, RecursionError, MemoryError):
                pass
        else:
            position = at(damage_offset(text, language))
        return [*facts, _fact("damage", position, role="syntax", body=problem)]
    if language == "python":
        facts += _python(text, at)
        tokens = [(m[1], m.start(1), m.end(1)) for m in TOKEN["python"].finditer(text)]
        used: set[int] = set()
    else:
        own, used = _rust(text, at, read[0]) if language == "rust" else _c(text, at, language, read[0])
        tokens = read[0].all
        facts += own
    return facts + list(_comments(tokens, at, language, used))
