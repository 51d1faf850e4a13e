"""Syntactic validity of Python, Rust, C and C++ files by a pushdown reduction.

A file is lexed to one class character per token.  A stack then reduces innermost bracket groups first: each closed group becomes one
character whose bits say as which grammar roles (argument list, block, fields, ...) its content parses, so every nesting level is a flat
string checked by compiled expressions.  The indented blocks of Python are one more kind of group; what the stack says of a Python file is then
confirmed by the interpreter's own parser, whose verdict is exact.
"""

from __future__ import annotations

import _symtable
import re
import warnings
from functools import lru_cache

from factloom.functions.lexing import PYTHON_TOKEN, TOKEN, flattened, tokens

_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: .*)?\r?$|^={7}\r?$", re.M)
_PAREN, _SQUARE, _BRACE = 0xE000, 0xE100, 0xE200
_BAD = "\x00"


def _having(base: int, bits: int, flag: int) -> str:
    return "[" + "".join(chr(base + v) for v in range(1 << bits) if v & flag) + "]"


def _any(base: int, bits: int) -> str:
    return f"[{chr(base)}-{chr(base + (1 << bits) - 1)}]"


class _Classes(dict):
    """Token spelling to class character, filled on demand and emptied when literals have made it large."""

    def __init__(self, classify):
        super().__init__()
        self.classify = classify

    def __missing__(self, token: str) -> str:
        value = self.classify(token)
        if len(self) > 100_000:
            self.clear()
        if len(token) < 40:
            self[token] = value
        return value


# --------------------------------------------------------------------------------------------------------------- C family

#: Keywords by role, C.
_C_WORDS = {
    "t": "void char short int long float double signed unsigned bool _Bool _Complex auto wchar_t __int128",
    "q": "const static inline extern volatile register restrict typedef _Noreturn _Thread_local constexpr thread_local _Atomic __inline __extension__ noreturn",
    "S": "struct union enum", "I": "if", "E": "else", "W": "while", "F": "for", "D": "do", "H": "switch", "C": "case", "d": "default",
    "R": "return", "b": "break continue", "g": "goto", "z": "sizeof _Alignof alignof", "n": "true false nullptr NULL",
    "a": "__attribute__ __attribute __declspec _Alignas alignas asm __asm__ __asm",
}
#: What C++ adds.
_CPP_WORDS = {
    "t": "char8_t char16_t char32_t decltype", "q": "virtual explicit mutable friend typename noexcept consteval constinit requires export",
    "S": "class", "N": "namespace", "T": "template", "U": "using", "A": "public private protected", "O": "operator", "z": "new delete throw co_await co_yield co_return typeid",
    "X": "try", "x": "catch", "i": "this", "o": "and or xor bitand bitor", "!": "not compl",
    "l": "static_cast dynamic_cast const_cast reinterpret_cast",
}
_C_PUNCT = {
    "+": "u", "-": "u", "*": "m", "&": "m", "&&": "m", "!": "!", "~": "!", "++": "p", "--": "p", "->": ".", ".": ".", "->*": "o", "::": "@",
    "...": "v", "=": "=", "<": "<", ">": ">", "?": "?", ":": ":", ",": ",", ";": ";",
    "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}",
}
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)")
#: Spellings that a macro of another file may have; and a mark before words that only the place makes keywords.
_MACRO_NAME, _MODULE = re.compile(r"[A-Z][A-Z0-9_]{2,}$|__[a-z]\w*$"), "\x02"
#: Preprocessor directive names.
_DIRECTIVES = set("include include_next define undef if ifdef ifndef elif elifdef elifndef else endif pragma error warning line import embed".split()) | {""}
_NUMBER_OK = re.compile(
    r"(?:0[xX][\da-fA-F']+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]*|[uU]?i(?:8|16|32|64)|_\w+|f(?:16|32|64|128)|bf16)$"
)


def _c_class(cpp: bool):
    words = {w: k for k, v in _C_WORDS.items() for w in v.split()}
    if cpp:
        words |= {w: k for k, v in _CPP_WORDS.items() for w in v.split()}

    def classify(token: str) -> str:
        if token in words:
            return words[token]
        if token in _C_PUNCT and (cpp or token != "::"):
            return _C_PUNCT[token]
        first = token[0]
        if token.startswith(("//", "/*")) and len(token) > 1:
            return _BAD if token.startswith("/*") and (len(token) < 4 or not token.endswith("*/")) else ""
        if token.lstrip()[:1] == "#" and token != "##":
            m = _DIRECTIVE.match(token)
            return "#" + {"if": "1", "ifdef": "1", "ifndef": "1", "endif": "2", "else": "3"}.get(m[1], "3" if m[1][:4] == "elif" else "") if m[1] in _DIRECTIVES else _BAD
        if len(token) > 1 and token[-1] == '"':
            return "s"
        if len(token) > 2 and token[-1] == "'":
            return "n"
        if first.isdigit() or (first == "." and len(token) > 1):
            return "n" if _NUMBER_OK.match(token) else _BAD
        if first.isalpha() or first == "_":
            return "M" if _MACRO_NAME.match(token) else "i"
        if first == _MODULE:
            return "J"
        if token in ("/", "%", "^", "|", "||", "==", "!=", "<=", ">=", "<=>", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="):
            return "o"
        return "i" if token == "$" else _BAD

    return classify


def _c_rules(cpp: bool) -> dict:
    """Compiled role checks for each bracket kind and for the whole file."""
    p_args, p_params, p_type, p_for, p_decl = (_having(_PAREN, 5, 1 << k) for k in range(5))
    any_p, any_k, any_b = _any(_PAREN, 5), _any(_SQUARE, 2), _any(_BRACE, 5)
    k_expr, k_attr = _having(_SQUARE, 2, 1), _having(_SQUARE, 2, 2)
    b_init, b_block, b_class, b_enum, b_ext = (_having(_BRACE, 5, 1 << k) for k in range(5))
    targs = rf"(?:<[itqSmvn@,:=s<>.u!o?zl{any_p[1:-1]}{any_k[1:-1]}]*>)" if cpp else r"(?!)"
    attr = rf"(?:{k_attr}|a{any_p})"
    name = rf"(?:@?!?i{targs}?(?:@(?:T)?!?i{targs}?)*)" if cpp else "i"
    opname = rf"(?:(?:i{targs}?@)*O(?:[-+oum!p<>=,.t]{{1,3}}|{any_p}|{any_k}|si?|(?:[tqm]|{name})+))" if cpp else r"(?!)"
    kind = rf"(?:SS?{attr}*{name}?(?:i)?(?::(?:[Aqt,@]|{name})+)?(?:{b_class}|{b_enum})?|S{name}:[tq]+{b_enum}?)" if cpp else rf"(?:S{attr}*i?(?:{b_class}|{b_enum})?)"
    base = rf"(?:t(?:t|q|{any_p})*|{kind}|{name})"
    arrow = rf"(?:\.(?:[tqmS]|{any_p}|{name})+)" if cpp else r"(?!)"
    specs = rf"(?:(?:qs|q{p_args}?|{attr})*+{base}(?:q|{attr})*)"
    member = r"|(?:i@)+m" if cpp else ""
    pointer = rf"(?:m|q|{attr}|v{member})*"
    suffix = rf"(?:{k_expr}|{p_params}(?:q|{attr}|m)*{arrow}?)"
    declr = rf"(?:{pointer}(?:{name}|{opname}|{p_decl}|{k_expr}(?=[:=])|){suffix}*{attr}*)"
    lam = rf"(?:{any_k}{targs}?{p_params}?(?:q)*{arrow}?{b_block})" if cpp else r"(?!)"
    cast_kw = rf"(?:l{targs}{p_args})" if cpp else r"(?!)"
    typed = rf"(?:[tq]+(?:{p_args}|{b_init})(?:@{name})*|q{p_params}?{b_block})" if cpp else r"(?!)"
    prim = rf"(?:n|(?:s|i(?=s))+i?|{opname}{targs}?|{cast_kw}|{typed}|{lam}|{name}(?:{b_init})?|{p_args}|{p_type}{b_init}|{b_block}(?!))"
    postfix = rf"(?:p|{k_expr}|{p_args}|\.T?!?{name}|v)*"
    sizeof = rf"(?:z(?:{p_type}|v{p_args}|[tqi@m]+{k_expr}?{p_args}?|{k_expr}))"
    unary = rf"(?:(?:[um!pz]|{p_type}|z{k_expr})*(?:{prim}|{sizeof}){postfix}|z)"
    binary = r"(?:[oum=?:]|<<?|>>?|\.m)"
    fold = rf"(?:v{binary})?" if cpp else ""
    expr = rf"(?:{fold}{unary}(?:{binary}(?:{unary}|{b_init}|v))*)" if cpp else rf"(?:{unary}(?:{binary}(?:{unary}|{b_init}))*)"
    exprs = rf"(?:{expr}(?:,{expr})*)"
    init = rf"(?:=(?:{expr}|{b_init}|[d]|zi?)|{b_init}|{p_args})"
    declaration = rf"(?:{specs}(?:{declr}(?::{expr})?{init}?(?:,{declr}(?::{expr})?{init}?)*)?)"
    template = rf"(?:q?T{targs}?(?:q(?:{p_args}|{expr}))?)*" if cpp else ""
    ctor_init = rf"(?::{name}(?:{p_args}|{b_init})v?(?:,{name}(?:{p_args}|{b_init})v?)*)?" if cpp else ""
    function = rf"(?:{template}(?:{specs}|(?:q|{attr})*){pointer}(?:{name}|{opname}|{p_decl}){p_params}(?:q{p_args}?|i|m|{attr}|{p_params}|{k_expr})*{arrow}?{ctor_init}{b_block})"
    access = r"(?:A:)" if cpp else r"(?!)"
    namespace = rf"(?:q?N(?:{name})?{b_ext}|Ni={name};)" if cpp else r"(?!)"
    using = rf"(?:{template}U[Niq@t<>,m=v.Sa!on?uzl{any_p[1:-1]}{any_k[1:-1]}]+;)" if cpp else r"(?!)"
    linkage = rf"(?:qs{b_ext}|q?J(?:i(?:\.i)*)?(?::(?:i(?:\.i)*|A))?{attr}?;|q?J(?:s|<[^;]*>){attr}?;|q{b_ext}|a{any_p};)" if cpp else rf"(?:qs{b_ext}|aq?{any_p};)"
    outer = rf"(?>;|{access}|{namespace}|{linkage}|{using}|{function}|{template}{declaration};)"
    special = rf"(?>{template}(?:q|{attr})*!?{name}{p_params}(?:q|i)*(?:=[dz]|=zi?)?;|{template}q*{opname}{p_params}(?:q|i)*(?:=[dz])?;)" if cpp else r"(?!)"
    prefix = rf"(?:Iq?(?:{p_args}|{p_for})|W(?:{p_args}|{p_for})|F{p_for}|H(?:{p_args}|{p_for})|E|D|C{expr}(?:v{expr})?:|d:|i:(?!:)|{attr})"
    catch = rf"(?:X{b_block}(?:x{any_p}{b_block})+)" if cpp else r"(?!)"
    simple = rf"(?:;|aq?{any_p};|{b_block}|{catch}|R(?:{exprs}|{b_init})?;|b;|gi;|{using}|{exprs};|{template}{declaration};|{function})"
    statement = rf"(?>{prefix}*{simple})"
    variadic = r"(?:,?v)?"
    param = rf"(?:{specs}{declr}(?:=(?:{expr}|{b_init}))?|q?v)"
    enum_item = rf"{attr}*i{attr}*(?:={expr})?"
    init_item = rf"(?:(?:(?:\.i|{k_expr})+=?)?(?:{expr}|{b_init}))"
    paren = [
        rf"(?:(?:{expr}|{b_init}|{specs}{pointer}{k_expr}?)(?:,(?:{expr}|{b_init}|{specs}{pointer}))*|{specs}{pointer})?",
        rf"(?:{param}(?:,{param})*{variadic}|t)?",
        rf"{specs}{pointer}(?:{p_decl}{p_params}?)?{k_expr}*",
        rf"(?:{declaration}|{exprs})?;{expr}?(?:;(?:{exprs})?)?|{specs}{declr}:(?:{expr}|{b_init})|{declaration}",
        rf"{pointer}(?:{name}|{p_decl})?{suffix}*",
    ]
    square = [rf"(?:[m=]?)(?:,?m?i(?:={expr})?v?)*|{expr}|q?{expr}|(?:[iq@]+{any_p}?(?:,[iq@]+{any_p}?)*)?", rf"{any_k}"]
    brace = [
        rf"(?:{init_item}(?:,{init_item})*,?)?",
        rf"{statement}*+(?:(?:C{expr}|d|i):)*",
        rf"(?:{outer}|{special})*+",
        rf"(?:{enum_item}(?:,{enum_item})*,?)?",
        rf"{outer}*+",
    ]
    return {
        "(": (_PAREN, [re.compile(x) for x in paren]),
        "[": (_SQUARE, [re.compile(x) for x in square]),
        "{": (_BRACE, [re.compile(x) for x in brace]),
        "file": re.compile(rf"(?:{outer}|{special})*+" if cpp else rf"{outer}*+"),
        "start": re.compile(rf"(?:{statement}|{outer}|{special})*+"),
    }


# -------------------------------------------------------------------------------------------------------------------- Rust

#: Rust keywords by role.
_RUST_WORDS = {
    "f": "fn", "l": "let", "q": "mut ref", "V": "pub", "U": "use", "C": "const", "T": "static", "S": "struct union_", "E": "enum", "I": "impl",
    "R": "trait", "M": "mod", "Y": "type", "X": "extern", "a": "as", "d": "dyn", "h": "if", "e": "else", "w": "while", "p": "loop", "r": "for",
    "c": "match", "u": "unsafe async", "W": "where", "k": "crate", "y": "return break continue yield", "v": "move", "j": "in", "i": "self Self super await", "n": "true false",
}
_RUST_PUNCT = {
    "-": "-", "*": "*", "&": "&", "&&": "&", "!": "!", "::": "@", "->": "A", "=>": "F", "..": "t", "..=": "t", "...": "t", "=": "=", "<": "<",
    ">": ">", "?": "?", ":": ":", ",": ",", ";": ";", ".": ".", "|": "|", "||": "Z", "+": "+", "#": "#", "$": "$", "@": "B", "_": "_",
    "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}",
}
_RUST_NUMBER_OK = re.compile(r"(?:0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f(?:32|64))?$")


def _rust_class(token: str, _words={w: k for k, v in _RUST_WORDS.items() for w in v.split()}) -> str:
    if token in _words:
        return _words[token]
    if token in _RUST_PUNCT:
        return _RUST_PUNCT[token]
    first = token[0]
    if token.startswith(("//", "/*")) and len(token) > 1:
        if token[1] == "*" and (len(token) < 4 or not token.endswith("*/")):
            return _BAD
        if token[2:3] == "!":
            return ""
        return ""
    if len(token) > 1 and (token[-1] == '"' or (token[-1] == "#" and '"' in token)):
        return "s"
    if first == "'" or token.startswith("b'"):
        return _BAD if len(token) == 1 else "n" if token[-1] == "'" else "L"
    if first.isdigit():
        return "n" if _RUST_NUMBER_OK.match(token) else _BAD
    if first.isalpha() or first == "_":
        return "i"
    if token in ("/", "%", "^", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="):
        return "o"
    return _BAD


def _rust_rules() -> dict:
    p_expr, p_type, p_pat, p_param = (_having(_PAREN, 5, 1 << k) for k in range(4))
    any_p, any_k, any_b = _any(_PAREN, 5), _any(_SQUARE, 3), _any(_BRACE, 8)  # the last bit of each: any token tree, as in macros
    k_expr, k_type, k_attr = (_having(_SQUARE, 3, 1 << k) for k in range(3))
    b_block, b_fields, b_variants, b_arms, b_use, b_lit, b_items = (_having(_BRACE, 8, 1 << k) for k in range(7))
    group = rf"(?:{any_p}|{any_k}|{any_b})"
    attr = rf"(?:#!?{any_k})"
    vis = rf"(?:V{any_p}?)?"
    gen = rf"(?:<[iLCqn@&*+,:=?!<>dktAf_{any_p[1:-1]}{any_k[1:-1]}{any_b[1:-1]}rI-]*>)"
    seg = rf"(?:[ik]{gen}?(?:{p_type}(?:A[ik@]+{gen}?)?)?)"
    path = rf"(?:@?[ik]{gen}?(?:@(?:[ik]|{gen}){gen}?)*)"
    tpath = rf"(?:@?{seg}(?:@{seg})*)"
    atom = rf"(?:(?:&L?q?|\*[Cq]|d|I|r{gen})*(?:{tpath}(?:!{group})?|<[^;]*?>@{tpath}|{p_type}|{k_type}|!|_|L|(?:u|X|Xs)*f{any_p}(?:A(?:{tpath}|{p_type}))?|\?{tpath}))"
    ty = rf"(?:{atom}(?:\+{atom})*)"
    pat1 = rf"(?:(?:[&q]|iB)*(?:-?n(?:t(?:-?n)?)?|t-?n|t|s|_|{path}(?:!{group}|{p_pat}|{b_lit})?(?:t(?:-?n|{path})?)?|{p_pat}|{k_expr}))"
    pat = rf"(?:\|?{pat1}(?:\|{pat1})*)"
    closure = rf"(?:(?:u|v)*(?:Z|\|[^|;{any_b[1:-1]}]*\|)(?:A{tpath}(?={any_b}))?)"
    macro = rf"(?:{path}!i?{group})"

    # ``Q`` stands for a control-flow expression that reduce_control() has already replaced.
    cast = rf"(?:a(?:[&*]|q|C)*(?:{path}|{p_type}|_))"
    prim = rf"(?:n|s|{macro}|{path}{b_lit}|{path}|{p_expr}|{k_expr}|Q|u*v?{b_block}|_|<[^;]*?>@{path})"
    postfix = rf"(?:\?|{p_expr}|{k_expr}|\.(?:i|n)(?:@{gen})?|{cast})*+"
    prefix = rf"(?:[-!*]|&[*]?[Cq]?|{closure}|yL?|#{any_k})*"
    binary = r"(?:[-+*&|o=^]|Z|<<?=?|>>?=?)"
    un = rf"(?:{prefix}{prim}{postfix})"
    expr = rf"(?:(?:t|yL?)?{un}(?:(?:{binary}|t)(?:{un}|yL?))*t?|t|yL?)"
    head = rf"(?:(?:l{pat}=)?{expr}(?:&l{pat}={expr})*)"
    arms = b_arms
    control = rf"(?:L:)?(?:h{head}{b_block}(?:eh{head}{b_block})*(?:e{b_block})?|w{head}{b_block}|p{b_block}|r{pat}j{expr}{b_block}|c{expr}{arms})"
    ctl, leaf = "Q", expr
    where = rf"(?:W(?:[^;{any_b[1:-1]}])*)?"
    fn = rf"(?:(?:C|u|Xs?)*f[i]{gen}?{p_param}(?:A{ty})?{where}(?:{b_block}|;))"
    use = rf"(?:U@?(?:(?:\$?[ik]@)*(?:\$?[ik](?:a[i_])?|\*|{b_use}));)"
    bounds = rf"(?::(?:[^;=<{any_b[1:-1]}]|{gen})*)?"
    item = rf"(?>{attr}*{vis}(?:{fn}|{use}|(?:Cq?|Tq?)[i_]:{ty}(?:={expr})?;|S[i]{gen}?{where}(?:{b_fields}|{p_type}{where};|;)|E[i]{gen}?{where}{b_variants}|u?I{gen}?!?{ty}(?:r{ty})?{where}{b_items}|u?Ri{gen}?{bounds}{where}{b_items}|Mi(?:;|{b_items})|Yi{gen}?{bounds}(?:={ty})?{where};|Xki(?:a[i_])?;|u?Xs?{b_items}|{path}!i?(?:{any_b}|{any_p};|{any_k};)))"
    let = rf"(?:{attr}*l{pat}(?::{ty})?(?:={expr}(?:e{b_block})?)?;)"
    statement = rf"(?>;|{let}|{item}|{attr}*(?:{ctl}|(?:L:)?u?{b_block}|{path}!{any_b})(?![.?a]);?|{attr}*{expr};)"
    field = rf"{attr}*{vis}i:{ty}"
    tfield = rf"{attr}*{vis}{ty}"
    variant = rf"{attr}*i(?:{p_type}|{b_fields})?(?:={expr})?"
    arm = rf"{attr}*{pat}(?:h(?:l{pat}=)?{leaf})?F"
    lit = rf"{attr}*(?:[in](?::{expr})?|t{expr}?)"
    plit = rf"{attr}*(?:[in]:{pat}|q*i|t)"
    use_item = rf"@?(?:\$?[ik]@)*(?:\$?[ik](?:a[i_])?|\*|{b_use})"
    param = rf"{attr}*(?:&?L?q?i|q?i:{ty}|&?Lq?i|{pat}:{ty}|t|{ty})"
    paren = [
        rf"(?:{expr}(?:,{expr})*,?)?",
        rf"(?:{tfield}(?:,{tfield})*,?)?(?:t)?",
        rf"(?:{pat}(?:,{pat})*,?)?",
        rf"(?:{param}(?:,{param})*,?)?",
        r"[\s\S]*",
    ]
    square = [rf"(?:{expr}(?:,{expr})*,?|{expr};{expr}|{pat}(?:,{pat})*,?|i?Bt.*)?", rf"{ty}(?:;{expr})?", r"[\s\S]+"]
    brace = [
        rf"(?:#!{any_k})*{statement}*+(?:{attr}*{expr})?",
        rf"(?:{field}(?:,{field})*,?)?",
        rf"(?:{variant}(?:,{variant})*,?)?",
        rf"(?>{arm}(?:{b_block}(?![.?a]),?|{ctl}(?![.?a]),?|{expr}(?:,|$)))*+",
        rf"(?:{use_item}(?:,{use_item})*,?)?",
        rf"(?:{lit}(?:,{lit})*,?)?|(?:{plit}(?:,{plit})*,?)?",
        rf"(?:#!{any_k})*(?:{item}|;)*+",
        r"[\s\S]*",
    ]
    return {
        "(": (_PAREN, [re.compile(x) for x in paren]),
        "[": (_SQUARE, [re.compile(x) for x in square]),
        "{": (_BRACE, [re.compile(x) for x in brace]),
        "file": re.compile(rf"(?:#!{any_k})*(?:{item}|;)*+"),
        "start": re.compile(rf"(?:#!{any_k})*(?:{item}|{statement})*+"),
        "control": re.compile(control),
    }


# ------------------------------------------------------------------------------------------------------------------ Python

#: Python keywords by role.
_PY_WORDS = {
    "f": "def", "c": "class", "I": "if", "J": "elif", "e": "else", "W": "while", "F": "for", "N": "in", "R": "return", "b": "pass break continue", "M": "import", "G": "from", "a": "as", "H": "with", "X": "try",
    "Y": "except", "Z": "finally", "r": "raise", "A": "assert", "d": "del", "g": "global nonlocal", "L": "lambda", "o": "and or", "!": "not", "q": "is", "y": "yield", "w": "await", "s": "async", "n": "None True False",
}
_PY_PUNCT = {
    "+": "u", "-": "u", "*": "m", "**": "P", "@": "t", "~": "~", "=": "=", ":=": "x", "->": "p", ".": ".", "...": "n", ",": ",", ";": ";", ":": ":", "(": "(", ")": ")", "[": "[", "]": "]", "{": "D(", "}": ")",
}
_PY_NUMBER = re.compile(r"(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)$")
_PY_STRING_START = re.compile(r"[A-Za-z]{0,2}[\"']")


def _python_class(token: str, _words={w: k for k, v in _PY_WORDS.items() for w in v.split()}) -> str:
    if token in _words:
        return _words[token]
    if token in _PY_PUNCT:
        return _PY_PUNCT[token]
    first = token[0]
    if len(token) > 1 and token[-1] in "\"'" and _PY_STRING_START.match(token):
        return "S"
    if first.isdigit() or (first == "." and len(token) > 1):
        return "n" if _PY_NUMBER.match(token) else _BAD
    if token.isidentifier():
        return "i"
    if token in ("==", "!=", "<", ">", "<=", ">="):
        return "k"
    if token in ("/", "//", "%", "|", "&", "^", "<<", ">>"):
        return "o"
    return "Q" if len(token) > 1 and token[-1] == "=" else _BAD


def _python_rules() -> dict:
    """Roles of brackets and indented blocks; ``$`` ends a logical line, braces hold an indented block."""
    par, sq, block = _any(_PAREN, 1), _any(_SQUARE, 1), _having(_BRACE, 1, 1)
    prim = rf"(?:i|n|S+|{par}|{sq}|D{par})"
    unary = rf"(?:[u~!w]*{prim}(?:\.i|{par}|{sq})*+)"
    test = rf"(?:{unary}(?:(?:[uomPkqNt]|!N|q!){unary})*)"
    expr = rf"(?:(?:ix)?(?:L[^:;$]*:)*{test}(?:I{test}e(?:L[^:;$]*:)*{test})*)"
    yields = rf"(?:y(?:G{expr}|m?{expr}(?:,m?{expr})*,?)?)"
    several = rf"(?:m?{expr}(?:,m?{expr})*,?)"
    # the loop variables end at the first "in", so they hold no comparison
    target = rf"(?:m?[u~]*{prim}(?:\.i|{par}|{sq})*)"
    loop = rf"(?:s?F{target}(?:,{target})*,?N{expr}(?:I{expr})*)"
    item = rf"(?:[mP]?{expr}(?::m?{expr})?(?:={expr})?{loop}*|m|o|L[^:;$]*:{expr})"
    inside = rf"(?:{yields}|{item}(?:,{item})*,?)?"
    slice_ = rf"(?:{expr}?:{expr}?(?::{expr}?)?)"
    subscript = rf"(?:(?:{slice_}|{item})(?:,(?:{slice_}|{item}))*,?)?"
    dotted = r"i(?:\.i)*"
    small = (
        rf"(?:b|R{several}?|r(?:{expr}(?:G{expr})?)?|A{expr}(?:,{expr})?|d{several}|gi(?:,i)*|M{dotted}(?:ai)?(?:,{dotted}(?:ai)?)*|G[.n]*(?:{dotted})?M(?:m|{par}|i(?:ai)?(?:,i(?:ai)?)*)"
        rf"|ii{sq}?={expr}|(?:{yields}|{several}(?::{expr})?)(?:[=Q](?:{yields}|{several}))*)"
    )
    line = rf"(?:{small}(?:;{small})*;?\$)"
    suite = rf"(?:\${block}|{line})"
    with_item = rf"{expr}(?:a{target})?"
    compound = (
        rf"(?:t{expr}\$)*(?:s?fi{sq}?{par}(?:p{expr})?:{suite}|ci{sq}?{par}?:{suite}|I{expr}:{suite}(?:J{expr}:{suite})*(?:e:{suite})?|W{expr}:{suite}(?:e:{suite})?|s?F{target}(?:,{target})*,?N{several}:{suite}(?:e:{suite})?"
        rf"|X:{suite}(?:(?:Ym?(?:{expr}(?:,{expr})*(?:ai)?)?:{suite})+(?:e:{suite})?)?(?:Z:{suite})?|s?H(?:{with_item}(?:,{with_item})*|{par}):{suite}|i{several}(?:ai)?(?:,m?{expr}(?:ai)?)*(?:I{expr})?:{suite})"
    )
    # inside parentheses an import or a with statement renames, and a pattern may too
    renamed = rf"(?:[mP]?{expr}(?:={expr})?(?:a{target})?(?:,[mP]?{expr}(?:={expr})?(?:a{target})?)*,?)"
    statements = rf"(?>{compound}|{line})*+"
    return {
        "(": (_PAREN, [re.compile(rf"{inside}|{renamed}")]), "[": (_SQUARE, [re.compile(rf"{subscript}|{renamed}")]), "{": (_BRACE, [re.compile(rf"(?>{compound}|{line})++")]),
        "file": re.compile(statements), "start": re.compile(statements),
    }


def _python_shape(text: str) -> tuple[str, str | None]:
    """Classes of a file's tokens with line ends and indented blocks, and the damage that the stacks of brackets and indents meet."""
    classes = _machine("python")[0]
    out: list[str] = []
    opened: list[str] = []
    indents = [0]
    fresh, joined = True, False
    for m in PYTHON_TOKEN.finditer(text):
        token = m[1]
        if token[0] == "#":
            continue
        start = m.end() - len(token)
        broken = "\n" in text[m.start() : start] or m.start() == 0
        if not broken and not fresh:
            # a comment between hides the line end from the blanks before this token
            broken = "\n" in text[last:start]
        if broken and not opened and not joined:
            if out and not fresh:
                out.append("$")
            line = text.rfind("\n", 0, start) + 1
            column = len(text[line:start].expandtabs(8))
            if column > indents[-1]:
                indents.append(column)
                out.append("{")
            while column < indents[-1]:
                indents.pop()
                out.append("}")
            if column != indents[-1]:
                return "", "inconsistent indentation"
        joined = token == "\\"
        last, fresh = m.end(), False
        if joined:
            continue
        if token in ("(", "[", "{"):
            opened.append(token)
        elif token in _OPENS:
            if not opened or opened.pop() != _OPENS[token]:
                return "", "unbalanced delimiter"
        elif token in ("'", '"'):
            return "", "unterminated literal or stray character"
        out.append(classes[token])
    if opened:
        return "", "input ended inside a delimiter"
    if not fresh:
        out.append("$")
    out.extend("}" for _ in indents[1:])
    return "".join(out), None


@lru_cache(maxsize=None)
def _machine(language: str):
    if language == "rust":
        return _Classes(_rust_class), _rust_rules()
    if language == "python":
        return _Classes(_python_class), _python_rules()
    return _Classes(_c_class(language == "cpp")), _c_rules(language == "cpp")


_BRACKET = re.compile(r"[(){}\[\]]")
_OPENS = {")": "(", "]": "[", "}": "{"}
_memo: dict[tuple, str] = {}
_IF_ZERO = re.compile(r"\s*#\s*if\s+0\s*$")
_DEFINED = re.compile(r"(?m)^\s*#\s*define\s+(\w+)")


def _contextual(lexed: list[str], language: str) -> list[str]:
    """Words that are keywords by their place: ``union`` before a name in Rust, ``module`` and ``import`` at the start of a C++ declaration."""
    words = ("union",) if language == "rust" else ("module", "import")
    if not any(w in lexed for w in words):
        return lexed
    out = list(lexed)
    code = [k for k, t in enumerate(lexed) if not t.startswith(("//", "/*"))]
    for n, k in enumerate(code):
        if lexed[k] in words:
            before = lexed[code[n - 1]] if n else ";"
            after = lexed[code[n + 1]] if n + 1 < len(code) else ""
            if language == "rust":
                if after[:1].isalpha() and before not in (".", "::", "let", "&", "(", ",", "mut"):
                    out[k] = "struct"
            elif (before in (";", "}", "{", "export") or before[:1] == "#") and (after[:1].isalpha() or after[:1] in '<";:_'):
                out[k] = _MODULE + lexed[k]
    return out



def reduce_control(rules: dict, content: str) -> str:
    """Replace control-flow expressions, innermost first, by one character each."""
    while True:
        content, n = rules["control"].subn("Q", content)
        if not n:
            return content


def _candidate_roles(language: str, kind: str, content: str, n: int):
    """Roles that the content cannot rule out by one character that only some of them may hold."""
    if kind != "{" or language == "python":
        return range(n)
    if language == "rust":
        if "F" in content:
            return (3, 7)
        return (0, 6, 7) if ";" in content else (0, 1, 2, 4, 5, 6, 7)
    if any(x in content for x in "RIWFHDb"):
        return (1,)
    return (1, 2, 4) if ";" in content else range(n)


def _roles(language: str, rules: dict, kind: str, content: str) -> int:
    """Bits of the grammar roles that the content of a bracket group parses as."""
    checks, bits = rules[kind][1], 0
    plain = reduce_control(rules, content) if "control" in rules and any(x in content for x in "hwprc") else content
    for k in _candidate_roles(language, kind, plain, len(checks)):
        if checks[k].fullmatch(plain):
            bits |= 1 << k
    return bits


_AROUND = f"[{chr(_PAREN)}-{chr(_PAREN + 255)}]", f"[{chr(_SQUARE)}-{chr(_SQUARE + 255)}]", f"[{chr(_BRACE)}-{chr(_BRACE + 255)}]"
#: Places where a macro of another file may stand for anything: before a type or name, as a whole statement, behind a declarator.
_MACRO_PLACES = tuple(
    re.compile(x.format(p=_AROUND[0], k=_AROUND[1][1:-1], b=_AROUND[2][1:-1], pp=_AROUND[0][1:-1]))
    for x in (
        r"(?<=I)M(?={p})|(?:(?<=^)|(?<=[;:{b}]))M{p}?(?:[{b}]|(?=[IWFHDCdRbgzUXp]|$))|M{p}?(?=[itqSTOMNA@!])|(?<=[iM{pp}{k}])M{p}?(?=[;=,:{{{b}]|$)",
        r"(?<=[itqSm{b}])M(?=[m)]|$)|(?<=m)M(?=i)",
    )
)
_MACRO_PREFIX = re.compile(rf"(?:(?<=^)|(?<=[;{_AROUND[2][1:-1]}]))i(?=[tqS])")


def _without_macros(content: str):
    """The content with its macros as names, then with those left out that stand where no name may."""
    yield content.replace("M", "i")
    content = _MACRO_PLACES[0].sub("", content)
    content = _MACRO_PREFIX.sub("", content)
    yield content.replace("M", "i")
    yield _MACRO_PLACES[1].sub("", content).replace("M", "i")


def _reduce_group(language: str, rules: dict, kind: str, content: str, lenient: bool = False) -> str:
    key = (language, kind, content, lenient)
    found = _memo.get(key)
    if found is None:
        bits = 0
        for variant in _without_macros(content) if lenient else (content,):
            bits |= _roles(language, rules, kind, variant)
            if bits:
                break
        found = chr(rules[kind][0] + bits)
        if len(_memo) > 200_000:
            _memo.clear()
        if len(content) < 400:
            _memo[key] = found
    return found


def _unskipped(lexed: list[str], kinds: list[str]) -> list[str]:
    """Classes with what stands below ``#if 0`` emptied: it need not be source at all."""
    out, stack = [], []
    for token, kind in zip(lexed, kinds):
        if kind == "#1":
            stack.append(_IF_ZERO.match(token) is not None)
        elif kind == "#3" and stack:
            stack[-1] = False
        elif kind == "#2" and stack:
            stack.pop()
        out.append("" if any(stack) and kind not in ("#1", "#2", "#3") else kind)
    return out


def _branches(lexed: list[str], shape: list[str], last: bool) -> list[str]:
    """Classes without directives and with one branch of each condition: the first, or the last; ``#if 0`` is always skipped."""
    followed, revived, open_at = set(), set(), []
    for at, kind in enumerate(shape):
        if kind == "#1":
            open_at.append(at)
        elif kind == "#2":
            open_at.pop()
        elif kind == "#3":
            followed.add(open_at[-1])
            if _IF_ZERO.match(lexed[open_at[-1]]):
                revived.add(at)
            open_at[-1] = at
    out, stack = [], []
    for at, (token, kind) in enumerate(zip(lexed, shape)):
        if kind[:1] != "#":
            if all(stack):
                out.append(kind)
        elif kind == "#1":
            stack.append(_IF_ZERO.match(token) is None and (not last or at not in followed))
        elif kind == "#2":
            stack.pop()
        elif kind == "#3":
            stack[-1] = (last and at not in followed) or at in revived
    return out


def _reduced(shape: str, language: str, lenient: bool) -> tuple[str, int] | None:
    """``(reason, place in the shape)`` of the first damage that the stack meets."""
    rules = _machine(language)[1]
    stack: list[tuple[str, list[str], int]] = []
    parts: list[str] = []
    at = 0
    for m in _BRACKET.finditer(shape):
        mark, k = m[0], m.start()
        if k > at:
            parts.append(shape[at:k])
        at = k + 1
        if mark in "([{":
            stack.append((mark, parts, k))
            parts = []
        else:
            if not stack or stack[-1][0] != _OPENS[mark]:
                return "unbalanced delimiter", k
            symbol = _reduce_group(language, rules, stack[-1][0], "".join(parts), lenient)
            opening, outer, start = stack.pop()
            if ord(symbol) & 0xFF == 0:
                # what stands in the arguments of a macro or an attribute need not be an expression
                before = outer[-1][-1] if outer and opening == "(" else ""
                if not before or (before not in ("Ma" if lenient else "a") and outer[-1][-2:] != "aq"):
                    return f"damaged content between {opening} and {mark}", start
                symbol = chr(_PAREN + 1)
            parts = outer
            parts.append(symbol)
    if stack:
        return "input ended inside a delimiter", stack[-1][2]
    parts.append(shape[at:])
    whole = "".join(parts)
    for variant in _without_macros(whole) if lenient else (whole,):
        if rules["file"].fullmatch(variant):
            return None
    return "damaged item", _place(shape, rules["file"].match(whole).end())


def _place(shape: str, taken: int) -> int:
    """Place in the shape of the symbol number ``taken`` of its outermost level."""
    depth = 0
    for k, c in enumerate(shape):
        if c in ")]}":
            depth -= 1
            continue
        if not depth:
            if not taken:
                return k
            taken -= 1
        depth += c in "([{"
    return max(0, len(shape) - 1)


def _braced_problem(lexed: list[str], language: str) -> str | None:
    classes = _machine(language)[0]
    if language == "rust":
        shape = "".join(map(classes.__getitem__, _contextual(lexed, language)))
        found = ("unterminated literal or stray character", 0) if _BAD in shape else _reduced(shape, language, False)
        return found and found[0]
    kinds = [classes[t] for t in (_contextual(lexed, language) if language == "cpp" else lexed)]
    shape = "".join(kinds)
    if "#1" in shape and any(k == "#1" and _IF_ZERO.match(t) for t, k in zip(lexed, kinds)):
        kinds = _unskipped(lexed, kinds)
        shape = "".join(kinds)
    if _BAD in shape:
        return "unterminated literal or stray character"
    conditions = "#1" in shape or "#2" in shape or "#3" in shape
    if conditions:
        depth = 0
        for mark in re.findall(r"#[123]", shape):
            depth += {"#1": 1, "#2": -1, "#3": 0}[mark]
            if depth < 0 or (depth == 0 and mark == "#3"):
                return "unbalanced preprocessor condition"
        if depth:
            return "input ended inside a preprocessor condition"
    whole = re.sub(r"#[123]?", "", shape)
    found = _reduced(whole.replace("M", "i"), language, False)
    if found is None:
        return None
    # a program of some configuration is one: macros of other files may stand for anything, and each condition has one branch at a time
    own = set(_DEFINED.findall("\n".join(t for t in lexed if t.lstrip()[:1] == "#"))) if "#" in shape else set()
    if own:
        kinds = ["M" if k == "i" and t in own else k for t, k in zip(lexed, kinds)]
    texts = dict.fromkeys(("".join(k for k in kinds if k[:1] != "#"), *("".join(_branches(lexed, kinds, last)) for last in (False, True) if conditions)))
    for text in texts:
        if ("M" in text or text != whole) and _reduced(text, language, True) is None:
            return None
    return found[0]


def damage_offset(text: str, language: str) -> int:
    """Where the damage of a Rust, C or C++ text begins: the token that the stack could not take, or the bracket around it."""
    found = list(TOKEN[language].finditer(flattened(text, language)))
    lexed = [m[1] for m in found]
    classes = _machine(language)[0]
    kinds = [classes[t] for t in _contextual(lexed, language)]
    for m, kind in zip(found, kinds):
        if kind == _BAD:
            return m.start(1)
    depth = []
    for m, kind in zip(found, kinds):
        if kind == "#1":
            depth.append(m.start(1))
        elif kind in ("#2", "#3") and language != "rust":
            if not depth:
                return m.start(1)
            if kind == "#2":
                depth.pop()
    if depth and language != "rust":
        return depth[-1]
    kept = [(k.replace("M", "i"), m.start(1)) for k, m in zip(kinds, found) if k and (language == "rust" or k[0] != "#")]
    problem = _reduced("".join(k for k, _ in kept), language, False)
    return kept[problem[1]][1] if problem and kept else 0


def _python_problem(text: str, words: bool = True) -> str | None:
    """Damage that the lexer, the stacks and the grammar of lines and blocks find, confirmed by the interpreter's own parser; or else what that finds.

    Without ``words`` only the verdict counts, which is the interpreter's in either case.
    """
    shape, reason = _python_shape(text) if words else ("", None)
    if reason is None and _BAD in shape:
        reason = "unterminated literal or stray character"
    if reason is None and words:
        found = _reduced(shape, "python", False)
        reason = found and found[0]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            _symtable.symtable(text, "source", "exec")
            return None
        except (SyntaxError, ValueError) as e:
            return reason or str(e).split(" (")[0].replace("\n", " ")
        except (RecursionError, MemoryError):
            return reason


def analyse(content: bytes | None, language: str | None, lex_python: bool = True, lexer=tokens, words: bool = True) -> tuple[str | None, str, list[str]]:
    """``(problem, text, tokens)`` of one file: why it is no valid program (``None`` when it is), its text and its tokens.

    A null content or language is not judged: ``(None, "", [])``.  Bytes that are no UTF-8 give no text.  A caller that asks for no ``words`` gets the
    same verdict with a reason of any wording.
    """
    if content is None or language is None:
        return None, "", []
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return "source is not valid UTF-8", "", []
    if text[:1] == "\ufeff":
        text = text[1:]
    lexed = lexer(text, language) if lex_python or language != "python" else []
    problem = _python_problem(text, words) if language == "python" else _braced_problem(lexed, language)
    if problem and re.search(r"^<{7}", text, re.M) and _CONFLICT.search(text):
        problem = "merge conflict marker"
    return problem, text, lexed


def syntax_problem(content: bytes | None, language: str | None) -> str | None:
    """Why the bytes are no valid program of the language; ``None`` when they are one (or nothing is to be judged)."""
    return analyse(content, language, lex_python=False)[0]
