"""Declarations of Rust, C and C++ files: a recursive-descent reader over the token list with a stack of scopes.

Each reader walks the tokens of a valid file once, keeps the matching bracket of every bracket, and yields the declared names with their roles and
the declarations that owe documentation.  Nothing is looked up in raw text, so comments, directives and literals may stand anywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from factloom.functions.lexing import TOKEN, flattened

_PAIR = {"(": ")", "[": "]", "{": "}"}
_CLOSE = frozenset(")]}")
_BRACKETS = frozenset("()[]{}")


@dataclass
class Declared:
    """One declaration that owes documentation: a callable or another item."""

    name: str
    at: int  # offset of the name
    begin: int  # offset where the declaration begins, attributes and template line included
    end: int  # offset behind its body or semicolon
    kind: str  # callable, item
    tier: str = "internal"  # public, internal, or authority where project facts decide
    owner: str = ""  # trait of a Rust function
    params: list[str] = field(default_factory=list)
    template: list[str] = field(default_factory=list)
    shape: str | None = None
    unsafe: bool = False
    effect: bool = False
    partial: bool = False  # a parameter has no name
    fixed: bool = False  # constructors, destructors and operators, whose spelling nobody chose
    public: bool = False
    head: int = -1  # offset behind the attributes of a Rust item


class Tokens:
    """Code tokens with their places and brackets; comments and directives are kept apart."""

    def __init__(self, text: str, language: str):
        self.text = flattened(text, language)
        self.comments: list[tuple[str, int, int]] = []
        self.directives: list[tuple[str, int, int]] = []
        rust = language == "rust"
        found = list(TOKEN[language].finditer(self.text))
        self.lexed: list[str] = [m[1] for m in found]
        starts = [m.end() - len(w) for m, w in zip(found, self.lexed)]
        apart = set()
        for k, w in [(k, w) for k, w in enumerate(self.lexed) if w[0] in "/#\\"]:
            if w[0] == "/":
                if w[1:2] not in ("/", "*") or len(w) < 2:
                    continue
                self.comments.append((w, starts[k], starts[k] + len(w)))
            elif w[0] == "#":
                if rust or w == "##":
                    continue
                self.directives.append((w, starts[k], starts[k] + len(w)))
            apart.add(k)
        if apart:
            self.word = [w for k, w in enumerate(self.lexed) if k not in apart]
            self.start = [a for k, a in enumerate(starts) if k not in apart]
        else:
            self.word, self.start = list(self.lexed), starts
        self.stop = [a + len(w) for a, w in zip(self.start, self.word)]
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for k, w in [(k, w) for k, w in enumerate(self.word) if w in _BRACKETS]:
            if w in _PAIR:
                stack.append(k)
            elif stack:
                self.pair[stack.pop()] = k
        for k in stack:
            self.pair[k] = len(self.word)

    @property
    def all(self) -> list[tuple[str, int, int]]:
        """Every token in source order, comments and directives included."""
        return sorted([*self.comments, *self.directives, *zip(self.word, self.start, self.stop)], key=lambda t: t[1])

    def get(self, k: int) -> str:
        return self.word[k] if 0 <= k < len(self.word) else ""

    def past(self, k: int) -> int:
        """Index behind the group that opens at ``k``, or behind the token."""
        return self.pair[k] + 1 if k in self.pair else k + 1

    def until(self, k: int, end: int, stops: frozenset) -> int:
        """First index from ``k`` on whose token is a stop outside all brackets, else ``end``."""
        while k < end and self.word[k] not in stops:
            k = self.past(k)
        return min(k, end)

    def angle(self, k: int, end: int) -> int:
        """Index behind the ``<...>`` that opens at ``k``; ``k`` itself when it does not close."""
        depth, j = 0, k
        while j < end:
            w = self.word[j]
            if w == "<":
                depth += 1
            elif w == "<=" or w in (";", "{") and w != "{":
                return k
            elif w[:1] == ">" and set(w) <= {">"}:
                depth -= len(w)
                if depth <= 0:
                    return j + 1
            if w in _PAIR:
                j = self.past(j)
            else:
                j += 1
        return k


def _is_name(word: str) -> bool:
    return word.isidentifier() or word[:2] == "r#" and len(word) > 2


# ------------------------------------------------------------------------------------------------------------------ C family

#: Words of C and C++ by what they may begin or be part of.
_QUALIFIERS = frozenset(
    "const volatile static extern inline register restrict __restrict __restrict__ __inline __inline__ _Noreturn noreturn _Thread_local thread_local __extension__ constexpr consteval constinit mutable virtual explicit friend typename export typedef _Atomic".split()
)
_BUILTIN = frozenset("void char short int long float double signed unsigned bool _Bool _Complex wchar_t char8_t char16_t char32_t auto __int128".split())
_STATEMENT = frozenset("return throw goto break continue delete co_return co_yield co_await new sizeof this".split())
_HEADED = frozenset("if while for switch".split())
_NO_NAME = _QUALIFIERS | _BUILTIN | _STATEMENT | _HEADED | frozenset(
    "else do case default struct union enum class namespace using template operator public private protected try catch static_assert decltype alignas alignof asm noexcept override requires concept nullptr true false".split()
)
_MACRO = re.compile(r"[A-Z][A-Z0-9_]{2,}$|__\w+$")
_DEFINE = re.compile(r"\s*#\s*define\s+(\w+)(\(([^)]*)\))?")
_ATTRIBUTES = frozenset("__attribute__ __attribute __declspec alignas _Alignas __asm__ asm __asm".split())
_COMMA_END = frozenset(",;")


@dataclass
class _Declarator:
    name: int = -1  # index of the name's token; -1 for an abstract one
    spelled: str = ""
    params: tuple[int, int] | None = None  # token range of a function's parameters
    pointer: bool = False  # the object is reached through a pointer or reference, so specifier const is not its own
    constant: bool = False  # its outermost derivation is const
    fixed: str = ""  # constructor, destructor, operator, conversion
    bindings: list[int] = field(default_factory=list)
    reference: bool = False


class CReader:
    """Names and documentation subjects of a C or C++ file."""

    def __init__(self, text: str, language: str, tokens: Tokens | None = None):
        self.t = tokens or Tokens(text, language)
        self.cpp = language == "cpp"
        self.names: list[tuple[int, str, str]] = []
        self.subjects: list[Declared] = []
        for token, start, _ in self.t.directives:
            m = _DEFINE.match(token)
            if m:
                self.names.append((start + m.start(1), m[1], "macro"))
                self.subjects.append(Declared(m[1], start + m.start(1), start, start + len(token), "item"))
                for p in re.finditer(r"[^\W\d]\w*", m[3] or ""):
                    self.names.append((start + m.start(3) + p.start(), p[0], "variable"))
        self.scope(0, len(self.t.word), "file", "")
        self.names.sort(key=lambda n: n[0])
        self.subjects.sort(key=lambda s: s.at)

    def name(self, k: int, role: str, spelled: str | None = None) -> None:
        self.names.append((self.t.start[k], spelled or self.t.word[k], role))

    # -- scopes

    def scope(self, k: int, end: int, kind: str, owner: str, access: str = "public") -> None:
        t = self.t
        while k < end:
            w = t.word[k]
            if w == ";" or w == ",":
                k += 1
            elif w == "{":
                self.scope(k + 1, t.pair[k], "block", "")
                k = t.past(k)
            elif (w in _PAIR or w in _CLOSE) and not (w == "[" and t.get(k + 1) == "["):
                k = t.past(k)
            elif kind == "class" and w in ("public", "private", "protected") and t.get(k + 1) == ":":
                access = w
                k += 2
            elif kind == "block" and w in _HEADED:
                k += 1
                while k < end and t.word[k] != "(" and t.word[k] not in ";{":
                    k += 1
                if k < end and t.word[k] == "(":
                    self.header(k + 1, t.pair[k])
                    k = t.past(k)
            elif w in ("else", "do", "try"):
                k += 1
            elif w == "catch" and t.get(k + 1) == "(":
                self.parameters(k + 2, t.pair[k + 1])
                k = t.past(k + 1)
            elif w in ("case", "default") and kind == "block":
                k = t.until(k, end, frozenset((":", ";"))) + 1
            elif kind == "block" and _is_name(w) and w not in _NO_NAME and t.get(k + 1) == ":" and t.get(k + 2) != ":":
                if not self.cpp:
                    self.name(k, "label")
                k += 2
            elif w in _STATEMENT and not (w == "new"):
                k = self.expression(k, end)
            else:
                k = self.declaration(k, end, kind, owner, access)

    def header(self, k: int, end: int) -> None:
        """Declarations in the parentheses of a control statement."""
        t = self.t
        colon = t.until(k, end, frozenset(":?;"))
        if colon < end and t.word[colon] == ":":
            self.declaration(k, colon, "header", "", "public")
            self.expression(colon + 1, end)
            return
        while k < end:
            stop = t.until(k, end, frozenset(";"))
            self.declaration(k, stop, "header", "", "public")
            k = stop + 1

    def expression(self, k: int, end: int) -> int:
        """Skip an expression statement; lambdas inside declare names, and so do nested blocks."""
        t = self.t
        while k < end and t.word[k] != ";":
            w = t.word[k]
            if w == "[" and self.cpp and (t.get(t.past(k)) in ("(", "{", "mutable") or t.get(t.past(k)) == "<") and not (k and (_is_name(t.word[k - 1]) and t.word[k - 1] not in _NO_NAME or t.word[k - 1] in (")", "]"))):
                k = self.closure(k, end)
                continue
            if w in ("(", "["):
                self.expression_list(k + 1, t.pair[k])
            elif w == "{":
                if k and t.word[k - 1] == "(":
                    self.scope(k + 1, t.pair[k], "block", "")
                else:
                    self.expression_list(k + 1, t.pair[k])
            k = t.past(k)
        return k + 1

    def expression_list(self, k: int, end: int) -> None:
        while k < end:
            k = self.expression(k, end)

    def closure(self, k: int, end: int) -> int:
        """A lambda: init captures, parameters, body."""
        t = self.t
        part = k + 1
        while part < t.pair[k]:
            stop = t.until(part, t.pair[k], frozenset(","))
            eq = t.until(part, stop, frozenset("="))
            if eq < stop and eq > part and _is_name(t.word[eq - 1]):
                self.name(eq - 1, "variable")
                self.expression_list(eq + 1, stop)
            part = stop + 1
        k = t.past(k)
        if t.get(k) == "<":
            after = t.angle(k, end)
            self.template(k, after)
            k = after
        if t.get(k) == "(":
            self.parameters(k + 1, t.pair[k])
            k = t.past(k)
        while k < end and t.word[k] not in ("{", ";", ",", ")"):
            k = t.past(k)
        if t.get(k) == "{":
            self.scope(k + 1, t.pair[k], "block", "")
            k = t.past(k)
        return k

    # -- declarations

    def template(self, k: int, end: int) -> list[str]:
        """Template parameters between ``<`` at ``k`` and ``end``."""
        t, out = self.t, []
        k += 1
        end -= 1
        while k < end:
            stop = k
            while stop < end and t.word[stop] != ",":
                after = t.angle(stop, end + 1) if t.word[stop] == "<" else stop
                stop = after if after > stop else t.past(stop)
            eq = min(t.until(k, stop, frozenset("=")), stop)
            part = [j for j in range(k, eq)]
            if part:
                last = part[-1]
                head = t.word[k]
                is_type = head in ("class", "typename") or head == "template"
                if len(part) > 1 and _is_name(t.word[last]) and t.word[last] not in _NO_NAME:
                    if is_type or not (len(part) == 1):
                        self.name(last, "type_parameter" if is_type else "const_parameter")
                        out.append(t.word[last])
                else:
                    out.append("")
            k = stop + 1
        return out

    def parameters(self, k: int, end: int) -> tuple[list[str], bool]:
        """Names of a parameter list, which it declares, and whether each parameter has one."""
        t, out, complete = self.t, [], True
        while k < end:
            stop = self.part(k, end)
            words = t.word[k:stop]
            if words == ["void"] or not words:
                pass
            elif words == ["..."]:
                complete = False
            else:
                before = len(self.names)
                default = t.until(k, stop, frozenset("="))
                named = self.parameter(k, default)
                if named:
                    out.append(named)
                else:
                    complete = False
                    del self.names[before:]
                if default < stop:
                    self.expression_list(default + 1, stop)
            k = stop + 1
        return out, complete

    def part(self, k: int, end: int) -> int:
        """End of one comma-separated part; commas in template arguments do not count."""
        t = self.t
        while k < end and t.word[k] != ",":
            if t.word[k] == "<" and self.cpp and k and _is_name(t.word[k - 1]):
                after = t.angle(k, end)
                if after > k:
                    k = after
                    continue
            k = t.past(k)
        return min(k, end)

    def parameter(self, k: int, end: int) -> str:
        k, spec = self.specifiers(k, end, "param", "")
        d = self.declarator(k, end, "param")
        if d.name >= 0:
            self.name(d.name, "variable")
            return self.t.word[d.name]
        return ""

    def attributes(self, k: int, end: int) -> tuple[int, bool]:
        """Skip attributes; tells whether one of them says that nothing is returned."""
        t, never = self.t, False
        while k < end:
            if t.word[k] == "[" and t.get(k + 1) == "[":
                j, close = k + 2, t.pair.get(k + 1, end)
                while j < close:  # the plain attribute alone, without a namespace or arguments
                    stop = t.until(j, close, frozenset(","))
                    never |= t.word[j:stop] in (["noreturn"], ["_Noreturn"])
                    j = stop + 1
                k = t.past(k)
            elif t.word[k] in _ATTRIBUTES and t.get(k + 1) == "(":
                k = t.past(k + 1)
            else:
                break
        return k, never

    def qualified(self, k: int, end: int) -> int:
        """Index behind a possibly qualified name with template arguments that begins at ``k``."""
        t = self.t
        if t.get(k) == "::":
            k += 1
        while k < end and _is_name(t.word[k]) and t.word[k] not in _NO_NAME:
            k += 1
            if k < end and t.word[k] == "<" and self.cpp:
                k = max(k, t.angle(k, end))
            if k + 1 < end and t.word[k] == "::" and (_is_name(t.word[k + 1]) or t.word[k + 1] == "template") and t.word[k + 1] != "operator":
                k += 2 if t.word[k + 1] == "template" else 1
                continue
            break
        return k

    def specifiers(self, k: int, end: int, kind: str, owner: str, access: str = "public") -> tuple[int, dict]:
        """Read declaration specifiers; definitions of classes and enumerations in them are declared on the way."""
        t = self.t
        spec = {"words": [], "typed": False, "never": False, "void": False, "auto": False, "class_at": None}
        while k < end:
            k, never = self.attributes(k, end)
            spec["never"] |= never
            if k >= end:
                break
            w = t.word[k]
            if w in _QUALIFIERS:
                spec["words"].append(w)
                spec["never"] |= w == "_Noreturn"
                k += 1
                if w in ("explicit", "_Atomic") and t.get(k) == "(":
                    spec["typed"] |= w == "_Atomic"
                    k = t.past(k)
                elif w == "extern" and k < end and t.word[k][-1:] == '"':
                    k += 1
            elif w in _BUILTIN:
                spec["typed"] = True
                spec["words"].append(w)
                spec["void"] |= w == "void"
                spec["auto"] |= w == "auto"
                k += 1
            elif w == "decltype" and t.get(k + 1) == "(":
                spec["typed"] = spec["auto"] = True
                k = t.past(k + 1)
            elif w in ("struct", "union", "enum", "class") and not spec["typed"]:
                spec["typed"] = True
                k = self.tagged(k, end, spec, kind, access)
            elif (_is_name(w) and w not in _NO_NAME or w == "::") and not spec["typed"]:
                after = self.qualified(k, end)
                if after == k:
                    break
                nxt = t.get(after) if after < end else ""
                if self.cpp and (nxt == "(" and (t.word[after - 1] == owner or self.own_constructor(k, after)) or nxt == "::" and t.get(after + 1) in ("~", "operator")):
                    break  # constructor, or a qualified destructor or operator
                if nxt == "(" and (_MACRO.match(w) and after == k + 1) and self.macro_call(after, end):
                    k = t.past(after)
                    continue
                if _MACRO.match(w) and after == k + 1 and after < end and (_is_name(nxt) and nxt not in ("operator",) or nxt in ("::",)) and self.type_follows(after, end):
                    k = after  # a macro that stands for a specifier
                    continue
                spec["typed"] = True
                spec["words"].append(w)
                k = after
            else:
                break
        return k, spec

    def type_follows(self, k: int, end: int) -> bool:
        """Whether a type and something to declare begin at ``k``: what stands before is then no type."""
        t = self.t
        if t.word[k] in _QUALIFIERS or t.word[k] in _BUILTIN or t.word[k] in ("struct", "union", "enum", "class", "decltype"):
            return True
        after = self.qualified(k, end)
        while after < end and t.word[after] in ("*", "&", "&&", "const"):
            after += 1
        return after > k and after < end and _is_name(t.word[after])

    def macro_call(self, k: int, end: int) -> bool:
        """Whether the macro call whose parentheses open at ``k`` is a specifier, as a declaration goes on behind it."""
        after = self.t.past(k)
        return after < end and (_is_name(self.t.word[after]) or self.t.word[after] in ("::", "[")) and self.t.word[after] not in _STATEMENT

    def own_constructor(self, k: int, after: int) -> bool:
        """``A::A(`` at namespace level."""
        words = self.t.word
        return after - k >= 3 and words[after - 2] == "::" and words[after - 1] in (words[after - 3], self._before_arguments(after - 3))

    def _before_arguments(self, k: int) -> str:
        while k > 0 and self.t.word[k] != "<":
            k -= 1
        return self.t.word[k - 1] if k else ""

    def tagged(self, k: int, end: int, spec: dict, kind: str, access: str) -> int:
        t = self.t
        keyword, begin = t.word[k], k
        k += 1
        if keyword == "enum" and t.get(k) in ("class", "struct"):
            k += 1
        k, _ = self.attributes(k, end)
        while k + 1 < end and _MACRO.match(t.word[k]) and _is_name(t.word[k + 1]) and t.word[k + 1] not in ("final",):
            k += 1  # an export macro
        at = k if k < end and _is_name(t.word[k]) and t.word[k] not in _NO_NAME else -1
        if at >= 0:
            k = self.qualified(k, end)
        if t.get(k) == "final":
            k += 1
        body = k
        if t.get(k) == ":" and kind != "param":
            body = k
            while body < end and t.word[body] not in ("{", ";"):
                after = t.angle(body, end) if t.word[body] == "<" else body
                body = after if after > body else t.past(body)
        defined = body < end and t.word[body] == "{" and kind != "param" or (kind == "param" and t.get(k) == "{")
        last = self.t.word[k - 1] if at >= 0 else ""
        if at >= 0 and (defined or (t.get(k) in (";", "") and k >= end - 1 or t.get(k) == ";" or keyword == "enum" and t.get(k) == ":")):
            role = "tag" if not self.cpp else "type"
            self.name(at if k - at == 1 else at, role)
            spec["class_at"] = (at, begin)
        elif defined:
            spec["class_at"] = (-1, begin)
        if defined:
            if keyword == "enum":
                self.enumerators(body + 1, t.pair[body])
            else:
                self.scope(body + 1, t.pair[body], "class", last, "private" if keyword == "class" else "public")
            return t.past(body)
        return body if t.get(k) == ":" and keyword == "enum" and body < end and t.word[body] == ";" else k

    def enumerators(self, k: int, end: int) -> None:
        t = self.t
        while k < end:
            stop = t.until(k, end, frozenset(","))
            k, _ = self.attributes(k, stop)
            if k < stop and _is_name(t.word[k]):
                self.name(k, "enum_member")
                self.subjects.append(Declared(t.word[k], t.start[k], t.start[k], t.stop[stop - 1], "item"))
            k = stop + 1

    def declarator(self, k: int, end: int, kind: str, owner: str = "") -> _Declarator:
        t = self.t
        d = _Declarator()
        while k < end:
            k, _ = self.attributes(k, end)
            w = t.get(k) if k < end else ""
            if w in ("*", "&", "&&", "^"):
                d.pointer, d.constant = True, False
                d.reference = w in ("&", "&&")
                k += 1
            elif w in ("const", "volatile", "restrict", "__restrict", "__restrict__", "_Nonnull", "_Nullable"):
                d.constant |= w == "const" and d.pointer and not d.reference
                k += 1
            elif w == "..." and self.cpp:
                k += 1
            elif self.cpp and _is_name(w) and w not in _NO_NAME and t.get(k + 1) == "::" and t.get(k + 2) == "*":
                d.pointer = True
                k += 3
            elif _MACRO.match(w) and k + 1 < end and (_is_name(t.word[k + 1]) and t.word[k + 1] not in _NO_NAME or t.word[k + 1] in ("*", "operator")):
                k += 1  # a calling convention
            else:
                break
        if k >= end:
            self.next = k
            return d
        w = t.word[k]
        if w == "(" and t.get(k + 1) in ("*", "&", "&&", "^", "(") or w == "(" and _MACRO.match(t.get(k + 1)) and t.get(k + 2) == "*" or (w == "(" and self.cpp and _is_name(t.get(k + 1)) and t.get(k + 2) == "::" and t.get(k + 3) == "*"):
            inner = self.declarator(k + 1, t.pair[k], kind)
            k = t.past(k)
            if inner.params is not None or inner.pointer:
                d.name, d.spelled, d.constant, d.pointer, d.params, d.reference = inner.name, inner.spelled, inner.constant, inner.pointer, inner.params, inner.reference
            else:
                d.name, d.spelled = inner.name, inner.spelled
            while k < end and t.word[k] in ("(", "["):
                if t.word[k] == "(":
                    if inner.pointer or inner.params is not None:
                        self.parameters(k + 1, t.pair[k])
                    else:
                        d.params = (k + 1, t.pair[k])
                k = t.past(k)
            self.next = k
            return d
        if w == "[" and self.cpp and kind in ("block", "header", "file", "namespace"):
            d.bindings = [j for j in range(k + 1, t.pair[k]) if _is_name(t.word[j])]
            self.next = t.past(k)
            return d
        if self.cpp:
            begin = k
            if _is_name(w) and w not in _NO_NAME or w == "::":
                after = self.qualified(k, end)
                if t.get(after) == "::" and t.get(after + 1) in ("~", "operator"):
                    k, w = after + 1, t.word[after + 1]
                elif t.get(after) == "(" and after < end and (t.word[after - 1] == owner or self.own_constructor(begin, after)):
                    d.name, d.spelled, d.fixed = after - 1, t.word[after - 1], "constructor"
                    k = after
            if w == "~" and _is_name(t.get(k + 1)):
                d.name, d.spelled, d.fixed = k, "~" + t.word[k + 1], "destructor"
                k += 2
            elif w == "operator":
                d.name, d.fixed = k, "operator"
                j = k + 1
                if t.get(j) in ("(", "["):
                    j = t.past(j)
                    d.spelled = "operator" + t.word[k + 1] + t.word[j - 1]
                elif t.get(j)[:1] == '"':
                    j += 1 if len(t.word[j]) > 2 or t.get(j + 1) == "(" else 2
                    d.spelled = "operator" + "".join(t.word[k + 1 : j])
                elif _is_name(t.get(j)) and t.get(j) not in ("new", "delete", "co_await") or t.get(j) == "::":
                    d.fixed = "conversion"
                    j = t.until(j, end, frozenset("("))
                    d.spelled = "operator " + "".join(t.word[k + 1 : j]) + "()"
                else:
                    while j < end and t.word[j] != "(":
                        j = t.past(j) if t.word[j] == "[" else j + 1
                    joined = "".join(t.word[k + 1 : j])
                    d.spelled = "operator" + (" " + joined if joined[:1].isalpha() else joined)
                k = j
        if d.name < 0 and _is_name(w) and w not in _NO_NAME:
            after = self.qualified(k, end) if self.cpp else k + 1
            last = after - 1
            while last > k and not _is_name(t.word[last]):
                last -= 1
            if t.word[after - 1][:1] == ">":
                last = k
                j = k
                while j < after:
                    if _is_name(t.word[j]) and (j == k or t.word[j - 1] == "::"):
                        last = j
                    j = t.angle(j, after) if t.word[j] == "<" and t.angle(j, after) > j else j + 1
            d.name, d.spelled = last, t.word[last]
            k = after
        while k < end and t.word[k] in ("(", "["):
            if t.word[k] == "[" and t.get(k + 1) == "[":
                k, _ = self.attributes(k, end)
                continue
            if t.word[k] == "(":
                if d.params is not None or not (d.fixed or d.name < 0 or self.looks_like_parameters(k + 1, t.pair[k], kind)):
                    break
                d.params = (k + 1, t.pair[k])
                d.pointer = False if d.name >= 0 else d.pointer
            k = t.past(k)
        self.next = k
        return d

    def looks_like_parameters(self, k: int, end: int, kind: str) -> bool:
        """Whether parentheses behind a name hold parameters rather than an initial value."""
        t = self.t
        if k >= end:
            return True
        w = t.word[k]
        if w in _QUALIFIERS or w in _BUILTIN or w in ("struct", "union", "enum", "class", "decltype", "...", "[") or w in _ATTRIBUTES:
            return True
        if not (_is_name(w) or w == "::") or w in _NO_NAME:
            return False
        after = self.qualified(k, end)
        if after >= end:
            return kind not in ("block", "header")
        nxt = t.word[after]
        if nxt in ("*", "&", "&&", "const", "..."):
            behind = after + 1
            while behind < end and t.word[behind] in ("*", "&", "&&", "const", "restrict", "..."):
                behind += 1
            return behind >= end or t.word[behind] in (",", "=", "[", ")", "(") or (_is_name(t.word[behind]) and (behind + 1 >= end or t.word[behind + 1] in (",", "=", "[", "(")))
        if nxt == ",":
            return kind not in ("block", "header")
        return _is_name(nxt) or nxt == "=" and kind not in ("block", "header") or nxt == "(" and t.get(after + 1) == "*"

    def declaration(self, k: int, end: int, kind: str, owner: str, access: str) -> int:
        t, begin = self.t, k
        template: list[str] = []
        templated = False
        while k < end and t.word[k] == "template" and self.cpp:
            k += 1
            if t.get(k) == "<":
                after = t.angle(k, end)
                if after == k:
                    return t.until(k, end, frozenset(";")) + 1
                templated = True
                template += self.template(k, after)
                k = after
            if t.get(k) == "requires":
                k += 1
                while k < end and (t.word[k] == "(" or t.word[k] in ("&&", "||", "!") or _is_name(t.word[k]) and (t.word[k - 1] in ("requires", "&&", "||", "!"))):
                    k = self.qualified(k, end) if _is_name(t.word[k]) else t.past(k)
        w = t.get(k) if k < end else ""
        if w == "export":
            k += 1
            w = t.get(k)
            if w == "{":
                self.scope(k + 1, t.pair[k], kind, owner)
                return t.past(k)
        if w in ("inline", "extern") and t.get(k + 1) == "namespace":
            k += 1
            w = "namespace"
        if w == "namespace":
            k, _ = self.attributes(k + 1, end)
            while k < end and (_is_name(t.word[k]) or t.word[k] == "::"):
                if _is_name(t.word[k]) and t.word[k] != "inline" and not _MACRO.match(t.word[k]):
                    self.name(k, "namespace")
                k += 1
            if t.get(k) == "{":
                self.scope(k + 1, t.pair[k], "namespace", "")
                return t.past(k)
            return t.until(k, end, frozenset(";")) + 1
        if w == "extern" and t.get(k + 1)[-1:] == '"' and t.get(k + 2) == "{":
            self.scope(k + 3, t.pair[k + 2], kind, owner)
            return t.past(k + 2)
        if w == "using":
            stop = t.until(k, end, frozenset(";"))
            j, _ = self.attributes(k + 2, stop)
            if t.get(j) == "=" and _is_name(t.get(k + 1)):
                self.name(k + 1, "type")
                self.specifiers(j + 1, stop, "block", "")
            return stop + 1
        if w in ("static_assert", "_Static_assert", "asm", "__asm__", "module", "import") and (w not in ("module", "import") or self.cpp and kind in ("file", "namespace") and (_is_name(t.get(k + 1)) or t.get(k + 1)[:1] in '<":;') and t.get(k + 1) not in ("=",)):
            return t.until(k, end, frozenset(";")) + 1
        if w == "concept" and _is_name(t.get(k + 1)):
            self.name(k + 1, "type")
            return t.until(k, end, frozenset(";")) + 1
        if kind in ("file", "namespace", "class") and _MACRO.match(w) and self.statement_macro(k, end):
            k = t.past(k + 1) if t.get(k + 1) == "(" else k + 1
            return t.past(k) if t.get(k) == "{" else k
        first = len(self.names)
        after, spec = self.specifiers(k, end, kind, owner, access)
        if spec["class_at"] is not None:
            at, _ = spec["class_at"]
            if at >= 0:
                name = t.word[at]
                self.subjects.append(Declared(name, t.start[at], t.start[begin], t.stop[min(after, len(t.word)) - 1] if after else 0, "item", template=template))
        if after == k:
            if self.cpp and kind in ("file", "namespace", "class") or self.cpp and t.get(k) in ("~", "operator"):
                pass
            elif kind in ("block", "header"):
                return self.expression(k, end)
            elif not (_is_name(t.get(k)) and t.get(k + 1) == "("):
                return self.expression(k, end)
        if after >= end or t.word[after] == ";":
            return after + 1
        if kind in ("block", "header") and not self.declares(k, after, end, spec):
            del self.names[first:]
            return self.expression(k, end)
        return self.declarators(begin, k, after, end, kind, owner, access, spec, template if templated else None)

    def statement_macro(self, k: int, end: int) -> bool:
        """Whether an upper-case word at a scope's level stands for a whole declaration, as none goes on behind it."""
        t = self.t
        after = t.past(k + 1) if t.get(k + 1) == "(" else k + 1
        if after >= end:
            return True
        w = t.word[after]
        if t.get(k + 1) == "(" and w == "{":
            return True
        return w in ("template", "namespace", "using", "typedef", "struct", "class", "enum", "union", "extern", "static", "public", "private", "protected", "}") and (t.get(k + 1) == "(" or w in ("template", "namespace", "using", "typedef", "public", "private", "protected"))

    def declares(self, k: int, after: int, end: int, spec: dict) -> bool:
        """Whether a statement of a block that begins with a type name is a declaration."""
        t = self.t
        if any(w in _QUALIFIERS or w in _BUILTIN for w in spec["words"]) or spec["class_at"] is not None or t.word[k] in ("struct", "union", "enum", "class"):
            return True
        if not spec["typed"]:
            return False
        j = after
        while j < end and t.word[j] in ("*", "&", "&&", "const", "restrict", "volatile"):
            j += 1
        if j >= end:
            return False
        if not _is_name(t.word[j]) or t.word[j] in _NO_NAME:
            return j == after and t.word[j] == "(" and t.get(j + 1) == "*" and t.get(t.past(j)) == "(" and _is_name(t.get(j + 2)) and self.looks_like_parameters(t.past(j) + 1, t.pair.get(t.past(j), 0), "block")
        return True

    def declarators(self, begin: int, k: int, after: int, end: int, kind: str, owner: str, access: str, spec: dict, template: list[str] | None) -> int:
        t = self.t
        words = spec["words"]
        const = "const" in words or "constexpr" in words
        k = after
        while k < end:
            d = self.declarator(k, end, kind, owner)
            k = self.next
            if d.name < 0 and not d.bindings and k == after:
                return self.expression(k, end)
            if d.bindings:
                constant = const and not d.reference
                for b in d.bindings:
                    self.name(b, "constant" if constant else "variable")
            elif d.params is not None and d.name >= 0:
                k = self.function(begin, k, end, kind, access, spec, d, template)
                if k < 0:
                    return -k
            elif d.name >= 0:
                own = d.constant or (const and not d.pointer)
                role = "constant" if own else "variable"
                if "typedef" in words:
                    role = "type" if self.cpp else "typedef"
                elif role == "variable" and self.cpp and kind == "class" and access == "private" and "static" not in words:
                    role = "private_member"
                self.name(d.name, role)
                if kind == "class":
                    self.subjects.append(Declared(d.spelled, t.start[d.name], t.start[begin], t.stop[t.until(k, end, _COMMA_END) - 1], "item"))
            if k < end and t.word[k] == ":" and kind == "class":
                k = t.until(k, end, frozenset(",;={"))
            if k < end and t.word[k] in ("=", "{", "("):
                stop = self.initial(k, end)
                k = stop
            k, _ = self.attributes(k, end)
            if k < end and t.word[k] == ",":
                k += 1
                after = -1
                continue
            break
        if k < end and t.word[k] not in (";",):
            stop = t.until(k, end, frozenset((";", "}")))
            self.expression_list(k, stop)
            k = stop
        return k + 1

    def initial(self, k: int, end: int) -> int:
        """Skip an initial value up to the comma or semicolon behind it; lambdas in it declare names."""
        t = self.t
        stop = k
        while stop < end and t.word[stop] not in (",", ";"):
            if t.word[stop] == "<" and self.cpp and stop and _is_name(t.word[stop - 1]):
                angled = t.angle(stop, end)
                if angled > stop and t.get(angled) in ("(", "{", "::", ">", ",", ")", ";"):
                    stop = angled
                    continue
            stop = t.past(stop)
        stop = min(stop, end)
        self.expression_list(k, stop)
        return stop

    def function(self, begin: int, k: int, end: int, kind: str, access: str, spec: dict, d: _Declarator, template: list[str] | None) -> int:
        """One function declarator; ``-next`` when its body ended the declaration."""
        t = self.t
        if "typedef" in spec["words"]:
            self.name(d.name, "type" if self.cpp else "typedef")
            self.parameters(*d.params)
            return k
        if not d.fixed:
            self.name(d.name, "function")
        params, complete = self.parameters(*d.params)
        arrow = None
        while k < end and t.word[k] not in (";", "{", ",", "=", ":"):
            if t.word[k] == "->":
                arrow = k + 1
                k += 1
                while k < end and t.word[k] not in (";", "{", "="):
                    angled = t.angle(k, end) if t.word[k] == "<" else k
                    k = angled if angled > k else t.past(k)
                continue
            k = t.past(k)
        body = None
        if k < end and t.word[k] == ":" and self.cpp:
            k += 1
            while k < end:
                k = self.qualified(k, end)
                if k < end and t.word[k] in ("(", "{"):
                    self.expression_list(k + 1, t.pair[k])
                    k = t.past(k)
                if t.get(k) == "...":
                    k += 1
                if k < end and t.word[k] == ",":
                    k += 1
                    continue
                break
        if k < end and t.word[k] == "{":
            body = k
        elif k < end and t.word[k] == "=":
            k += 1
            while k < end and t.word[k] not in (";", ","):
                k += 1
        stop = t.stop[min(t.pair[body] if body is not None else k, len(t.word) - 1)]
        if kind not in ("block", "header"):
            self.subjects.append(
                Declared(
                    d.spelled, t.start[d.name], t.start[begin], stop, "callable", tier="internal" if "static" in spec["words"] and kind != "class" else "authority", params=params, template=[x for x in template or [] if x],
                    shape=self.shape(spec, d, arrow, k), effect=d.fixed in ("constructor", "destructor", "operator"), partial=not complete or "" in (template or []), fixed=bool(d.fixed),
                )
            )
        if body is not None:
            self.scope(body + 1, t.pair[body], "block", "")
            following = t.past(body)
            while t.get(following) == "catch" and t.get(following + 1) == "(":
                self.parameters(following + 2, t.pair[following + 1])
                following = t.past(following + 1)
                if t.get(following) == "{":
                    self.scope(following + 1, t.pair[following], "block", "")
                    following = t.past(following)
            return -following
        return k

    def shape(self, spec: dict, d: _Declarator, arrow: int | None, end: int) -> str:
        if spec["never"]:
            return "Never"
        if d.fixed in ("constructor", "destructor"):
            return "NoValue"
        if d.fixed == "conversion":
            return "Value"
        if arrow is not None:
            words = self.t.word[arrow:end]
            return "NoValue" if words[:1] == ["void"] and "*" not in words else "Unknown" if "decltype" in words or "auto" in words else "Value"
        if spec["auto"]:
            return "Unknown"
        if spec["void"] and not d.pointer and self.t.word[d.name - 1] not in ("*", "&"):
            return "NoValue"
        return "Value" if spec["typed"] else "Unknown"


# ---------------------------------------------------------------------------------------------------------------------- Rust

_RUST_LITERAL = re.compile(r'r(#*)"([\s\S]*)"\1|"([\s\S]*)"')
_RUST_ESCAPE = re.compile(r"\\(?:x([0-7][0-9a-fA-F])|u\{([0-9a-fA-F_]+)\}|\r?\n\s*|(.))")


def decoded(body: str) -> str:
    """Text of a Rust literal: escapes decoded, line continuations gone with the blanks that follow."""

    def one(m: re.Match) -> str:
        point = m[1] or m[2]
        if point:
            value = int(point.replace("_", "") or "0", 16)
            return chr(value) if value < 0xD800 or 0xE000 <= value < 0x110000 else "\ufffd"
        return {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[3], m[3] or "")

    return _RUST_ESCAPE.sub(one, body)


def doc_attributes(t: Tokens):
    """``(start, end, text)`` of each ``#[doc = "..."]`` (F13); the text is ``None`` where the value is no text literal."""
    for k in range(len(t.word) - 4):
        if t.word[k] == "#" and t.word[k + 1] == "[" and t.word[k + 2] == "doc" and t.word[k + 3] == "=":
            close = t.pair[k + 1]
            literal = _RUST_LITERAL.fullmatch(t.word[k + 4]) if close == k + 5 else None
            yield t.start[k], t.stop[min(close, len(t.word) - 1)], None if literal is None else literal[2] if literal[2] is not None else decoded(literal[3])


_RUST_NOT_BOUND = frozenset("_ ref mut box true false self super crate Self const move static".split())
_RUST_ITEMS = frozenset("fn struct enum union trait type mod static const macro_rules impl use extern".split())
_ITEM_PREFIX = frozenset("pub default async unsafe const extern".split())
_ROLES = {"struct": "type", "enum": "type", "union": "type", "trait": "type", "type": "type", "mod": "module", "static": "constant", "const": "constant"}


class RustReader:
    """Names and documentation subjects of a Rust file."""

    def __init__(self, text: str, tokens: Tokens | None = None):
        self.t = tokens or Tokens(text, "rust")
        self.names: list[tuple[int, str, str]] = []
        self.subjects: list[Declared] = []
        self.uses: list[tuple[int, int, int, int]] = []  # offset of each use declaration, token range of its tree, and the block it stands in
        self.items(0, len(self.t.word), "", False, 0)
        self.names.sort(key=lambda n: n[0])
        self.subjects.sort(key=lambda s: s.at)

    def name(self, k: int, role: str) -> None:
        self.names.append((self.t.start[k], self.t.word[k], role))

    def items(self, k: int, end: int, owner: str, exported: bool, block: int) -> None:
        while k < end:
            k = self.item(k, end, owner, exported, False, block)

    def item(self, k: int, end: int, owner: str, exported: bool, nested: bool, block: int) -> int:
        """One item from its attributes on; whatever is none is skipped to the next semicolon or block."""
        t, begin = self.t, k
        marked = False
        while t.get(k) == "#" and k < end:
            after = k + 2 if t.get(k + 1) == "!" else k + 1
            marked |= "macro_export" in t.word[after : t.past(after)]
            k = t.past(after)
        public = unsafe = False
        self.head = t.start[k] if k < end else -1
        while k < end and t.word[k] in _ITEM_PREFIX:
            w = t.word[k]
            if w == "pub":
                public = t.get(k + 1) != "("
                k = t.past(k + 1) if t.get(k + 1) == "(" else k + 1
            elif w == "const" and t.get(k + 1) not in ("fn", "unsafe", "async", "extern"):
                break
            elif w == "extern":
                if t.get(k + 1) == "crate":
                    break
                k += 2 if t.get(k + 1)[-1:] in '"#' and '"' in t.get(k + 1) else 1
                if t.get(k) == "{":
                    self.items(k + 1, t.pair[k], "", False, t.start[k])
                    return t.past(k)
            else:
                unsafe |= w == "unsafe"
                k += 1
        w = t.get(k) if k < end else ""
        named = t.get(k + 1)
        if w == "union" and not (_is_name(named) and t.get(k + 2) in ("{", "<", "where")):
            w = ""
        if w == "use":
            stop = t.until(k, end, frozenset(";"))
            self.use_tree(k + 1, stop)
            self.uses.append((t.start[k if self.head < 0 else begin], k + 1, stop, block))
            if public:
                self.subjects.append(Declared(" ".join(t.word[k + 1 : stop]), t.start[k], t.start[begin], t.stop[stop - 1], "item", public=True))
            return stop + 1
        if w == "extern" and named == "crate":
            stop = t.until(k, end, frozenset(";"))
            if t.get(stop - 2) == "as" and _is_name(t.get(stop - 1)) and t.get(stop - 1) != "_":
                self.name(stop - 1, "module")
            return stop + 1
        if w == "macro_rules" and named == "!":
            self.name(k + 2, "macro")
            stop = t.past(k + 3)
            if marked:
                self.subjects.append(Declared(t.word[k + 2], t.start[k + 2], t.start[begin], t.stop[stop - 1], "item", public=True))
            return stop + 1 if t.get(stop) == ";" else stop
        if w == "impl":
            return self.implementation(k, end)
        if w == "fn" and _is_name(named):
            return self.function(begin, k, end, owner, (public or exported) and not nested, unsafe, nested)
        if w in _ROLES and (_is_name(named) or w in ("static", "const") and named in ("mut", "_")):
            return self.named_item(begin, k, end, public and not nested, exported, unsafe)
        if nested:
            return begin
        if _is_name(w) and t.until(k, end, frozenset(("!", ";", "{"))) < end and t.get(t.until(k, end, frozenset(("!", ";", "{")))) == "!":
            k = t.until(k, end, frozenset("!")) + 1
            while k < end and t.word[k] not in _PAIR:
                k += 1
            k = t.past(k)
            return k + 1 if t.get(k) == ";" else k
        return t.past(k) if k < end else end

    def use_tree(self, k: int, end: int) -> None:
        t = self.t
        for j in range(k, end):
            if t.word[j] == "as" and _is_name(t.get(j + 1)) and t.get(j + 1) != "_":
                self.name(j + 1, "alias")

    def generics(self, k: int, end: int) -> int:
        """Declare the parameters of ``<...>`` at ``k``; index behind them."""
        t = self.t
        if t.get(k) != "<":
            return k
        after = self.angle(k, end)
        j, depth, fresh = k + 1, 0, True
        while j < after - 1:
            w = t.word[j]
            if fresh:
                while t.get(j) == "#":
                    j = t.past(j + 1)
                w = t.word[j]
                if w.startswith("'"):
                    self.name(j, "lifetime")
                elif w == "const" and _is_name(t.get(j + 1)):
                    self.name(j + 1, "const_parameter")
                elif _is_name(w):
                    self.name(j, "type_parameter")
                fresh = False
            depth += (w == "<") - (w == ">")
            if w == "," and not depth:
                fresh = True
            j = t.past(j) if w in _PAIR else j + 1
        return after

    def angle(self, k: int, end: int) -> int:
        depth = 0
        while k < end:
            w = self.t.word[k]
            depth += (w == "<") - (w == ">")
            k = self.t.past(k) if w in _PAIR else k + 1
            if not depth:
                return k
        return end

    def behind_type(self, k: int, end: int, stops: frozenset) -> int:
        t = self.t
        while k < end and t.word[k] not in stops:
            k = self.angle(k, end) if t.word[k] == "<" else t.past(k)
        return min(k, end)

    def implementation(self, k: int, end: int) -> int:
        t = self.t
        j = k + 1
        if t.get(j) == "<":
            j = self.generics(j, end)
        stop = self.behind_type(j, end, frozenset(("{", ";")))
        where = self.behind_type(j, stop, frozenset(("where",)))
        split = self.behind_type(j, where, frozenset(("for",)))
        owner = "".join(w for w in t.word[j:split]) if split < where else ""
        self.items(stop + 1, t.pair.get(stop, stop), owner, False, t.start[stop] if stop < len(t.word) else 0)
        return t.past(stop)

    def named_item(self, begin: int, k: int, end: int, public: bool, exported: bool, unsafe: bool) -> int:
        t, w = self.t, self.t.word[k]
        at = k + 2 if t.get(k + 1) == "mut" else k + 1
        if t.word[at] != "_":
            self.name(at, _ROLES[w])
        j = self.generics(at + 1, end)
        if w in ("static", "const"):
            stop = self.behind_type(j, end, frozenset((";", "=")))
            if t.get(stop) == "=":
                last = t.until(stop, end, frozenset(";"))
                self.body(stop + 1, last)
                stop = last
        elif w == "type":
            stop = t.until(j, end, frozenset(";"))
        else:
            stop = self.behind_type(j, end, frozenset(("{", ";", "("))) if w == "struct" else self.behind_type(j, end, frozenset(("{", ";")))
            if w == "struct" and t.get(stop) == "(":
                self.tuple_fields(stop, public)
                stop = t.until(t.past(stop), end, frozenset(";"))
        if public or unsafe and w == "trait":
            last = t.pair.get(stop, stop)
            self.subjects.append(Declared(t.word[at], t.start[at], t.start[begin], t.stop[min(last, len(t.word) - 1)], "item", unsafe=unsafe and w == "trait", public=public))
        if t.get(stop) == "{":
            inner, close = stop + 1, t.pair[stop]
            if w in ("struct", "union"):
                self.fields(inner, close, public)
            elif w == "enum":
                self.variants(inner, close, public)
            elif w == "trait":
                self.items(inner, close, t.word[at], public, t.start[stop])
            else:
                self.items(inner, close, "", False, t.start[stop])
            return close + 1
        return stop + 1

    def tuple_fields(self, k: int, public: bool) -> None:
        t, j, n = self.t, k + 1, 0
        while j < t.pair[k]:
            stop = self.behind_type(j, t.pair[k], frozenset(","))
            first = j
            while t.get(first) == "#":
                first = t.past(first + 1)
            if public and t.get(first) == "pub" and t.get(first + 1) != "(":
                self.subjects.append(Declared(f"<tuple-field:{n}>", t.start[first], t.start[j], t.stop[stop - 1], "item", public=True))
            j, n = stop + 1, n + 1

    def fields(self, k: int, end: int, public: bool) -> None:
        t = self.t
        while k < end:
            begin = k
            while t.get(k) == "#" and k < end:
                k = t.past(k + 1)
            shown = False
            if t.get(k) == "pub":
                shown = t.get(k + 1) != "("
                k = k + 1 if shown else t.past(k + 1)
            stop = self.behind_type(k, end, frozenset(","))
            if k < end and _is_name(t.word[k]) and t.get(k + 1) == ":":
                self.name(k, "variable")
                if public and shown:
                    self.subjects.append(Declared(t.word[k], t.start[k], t.start[begin], t.stop[stop - 1], "item", public=True))
            k = stop + 1

    def variants(self, k: int, end: int, public: bool) -> None:
        t = self.t
        while k < end:
            begin = k
            while t.get(k) == "#" and k < end:
                k = t.past(k + 1)
            stop = t.until(k, end, frozenset(","))
            if k < stop and _is_name(t.word[k]):
                self.name(k, "enum_member")
                if public:
                    self.subjects.append(Declared(t.word[k], t.start[k], t.start[begin], t.stop[stop - 1], "item", public=True))
                if t.get(k + 1) == "{":
                    self.fields(k + 2, t.pair[k + 1], False)
            k = stop + 1

    def function(self, begin: int, k: int, end: int, owner: str, public: bool, unsafe: bool, nested: bool) -> int:
        t, at, head = self.t, k + 1, self.head
        self.name(at, "function")
        j = self.generics(at + 1, end)
        params: list[str] = []
        partial = False
        if t.get(j) == "(":
            p = j + 1
            while p < t.pair[j]:
                stop = self.behind_type(p, t.pair[j], frozenset(","))
                while t.get(p) == "#":
                    p = t.past(p + 1)
                colon = self.behind_type(p, stop, frozenset(":"))
                words = t.word[p:colon]
                if "self" not in words and colon < stop:
                    bound = self.pattern(p, colon, False)
                    names = [t.word[b].removeprefix("r#") for b in bound]
                    if len(names) == 1 and set(words) <= {"mut", t.word[bound[0]]}:
                        params += names
                    elif words != ["_"]:
                        partial = True
                p = stop + 1
            j = t.past(j)
        stop = self.behind_type(j, end, frozenset(("{", ";")))
        where = self.behind_type(j, stop, frozenset(("where",)))
        kind = t.word[j + 1 : where] if t.get(j) == "->" else ["(", ")"]
        shape = "NoValue" if kind == ["(", ")"] else "Never" if kind == ["!"] else "Unknown" if any(kind[n + 1 : n + 2] == ["!"] for n in range(len(kind))) or "$" in kind else "Value"
        last = t.pair.get(stop, stop)
        self.subjects.append(Declared(t.word[at], t.start[at], t.start[begin], t.stop[min(last, len(t.word) - 1)], "callable", tier="public" if public else "internal", owner=owner, params=params, shape=shape, unsafe=unsafe, partial=partial, public=public, head=head))
        if t.get(stop) == "{":
            self.body(stop + 1, t.pair[stop])
        return last + 1

    def pattern(self, k: int, end: int, refutable: bool) -> list[int]:
        """Indices of the names that a pattern binds, which it declares."""
        t, out, j = self.t, [], k
        while j < end:
            w = t.word[j]
            if _is_name(w) and w not in _RUST_NOT_BOUND:
                nxt = t.get(j + 1) if j + 1 < end else ""
                field_name = nxt == ":" and t.get(j - 1) in ("{", ",", "mut", "ref")
                constructor = nxt in ("(", "{", "::", "!") or t.get(j - 1) == "::"
                reference = w == "None" or refutable and w[:1].isupper() and len(w.removeprefix("r#")) > 1
                if nxt == "<":
                    j = self.angle(j + 1, end)
                    continue
                if not (field_name or constructor or reference):
                    self.name(j, "variable")
                    out.append(j)
            elif w == "#":
                j = t.past(j + 1)
                continue
            elif w == "if":
                break
            j += 1
        return out

    def body(self, k: int, end: int) -> None:
        """Statements and expressions of a block: items, patterns, closures, labels; macro calls are token trees and declare nothing."""
        t = self.t
        fresh = True  # a statement may begin here
        block = t.start[k - 1] if k else 0
        while k < end:
            w = t.word[k]
            if fresh and (w in _RUST_ITEMS or w in _ITEM_PREFIX or w == "#" or w == "union"):
                after = self.item(k, end, "", False, True, block)
                if after > k:
                    k = after
                    continue
                if w == "#":
                    k = t.past(k + 1)
                    continue
            fresh = False
            if w == "let":
                stop = self.behind_type(k + 1, end, frozenset(("=", ";", ":")))
                conditional = t.get(k - 1) in ("if", "while", "&&", "||", "(") or self.has_else(stop, end)
                if t.get(stop) == ":" and t.get(stop + 1) != ":":
                    self.pattern(k + 1, stop, conditional)
                    stop = self.behind_type(stop, end, frozenset(("=", ";")))
                else:
                    self.pattern(k + 1, stop, conditional)
                k = stop + 1
                fresh = t.get(stop) == ";"
                continue
            if w == "for" and t.get(k + 1) != "<":
                stop = t.until(k + 1, end, frozenset(("in", ";", "{")))
                if t.get(stop) == "in":
                    self.pattern(k + 1, stop, False)
                    k = stop + 1
                    continue
            if w.startswith("'") and t.get(k + 1) == ":" and len(w) > 1 and w[-1] != "'":
                self.name(k, "label")
                k += 2
                continue
            if w == "match":
                brace = t.until(k + 1, end, frozenset(("{", ";")))
                self.body(k + 1, brace)
                if t.get(brace) == "{":
                    self.arms(brace + 1, t.pair[brace])
                    k = t.past(brace)
                    fresh = True
                    continue
            if w in ("|", "||") and (k == 0 or t.word[k - 1] in ("(", ",", "=", "{", ";", "[", ":", "move", "return", "=>", "&", "async", "static", "&&", "!", "else", "in") or fresh):
                if w == "||":
                    k += 1
                    continue
                stop = k + 1
                while stop < end and t.word[stop] != "|":
                    stop = self.angle(stop, end) if t.word[stop] == "<" else t.past(stop)
                p = k + 1
                while p < stop:
                    comma = self.behind_type(p, stop, frozenset(","))
                    self.pattern(p, self.behind_type(p, comma, frozenset(":")), False)
                    p = comma + 1
                k = stop + 1
                continue
            if w == "!" and k and _is_name(t.word[k - 1]) and t.get(k + 1) in _PAIR and t.word[k - 1] not in ("return", "break", "in", "match", "if", "while"):
                k = t.past(k + 1)
                fresh = True
                continue
            if w in _PAIR:
                self.body(k + 1, t.pair[k])
                fresh = w == "{"
                k = t.past(k)
                continue
            fresh = w == ";"
            k += 1

    def has_else(self, k: int, end: int) -> bool:
        """Whether a let has an else block: its value may then not match."""
        t = self.t
        stop = t.until(k, end, frozenset((";", "else")))
        return t.get(stop) == "else" and t.get(t.past(stop + 1)) == ";" and "if" not in t.word[k:stop]

    def arms(self, k: int, end: int) -> None:
        t = self.t
        while k < end:
            arrow = t.until(k, end, frozenset(("=>",)))
            guard = t.until(k, arrow, frozenset(("if",)))
            self.pattern(k, guard, True)
            if guard < arrow:
                self.body(guard + 1, arrow)
            k = arrow + 1
            if t.get(k) == "{":
                self.body(k + 1, t.pair[k])
                k = t.past(k)
                if t.get(k) in (".", "?"):
                    stop = t.until(k, end, frozenset(","))
                    self.body(k, stop)
                    k = stop
                if t.get(k) == ",":
                    k += 1
            else:
                stop = self.arm_end(k, end)
                self.body(k, stop)
                k = stop + 1

    def arm_end(self, k: int, end: int) -> int:
        """Comma behind an arm's expression; commas between the parameters of a closure do not count."""
        t = self.t
        while k < end and t.word[k] != ",":
            if t.word[k] == "|" and t.get(k - 1) in ("=>", "(", ",", "=", "move"):
                k += 1
                while k < end and t.word[k] != "|":
                    k = t.past(k)
            k = t.past(k)
        return min(k, end)
