"""Declared names and documentation subjects of Rust, C and C++ sources: expected rows as the engine's contract states them."""

import pytest

from factloom.functions.declarations import CReader, RustReader


def read(text, language):
    return RustReader(text) if language == "rust" else CReader(text, language)


def names(text, language):
    return [n[1] for n in read(text, language).names]


RUST = """macro_rules! M { () => {} }
mod Q {
    use crate::thing as V;
    struct T<'a, K, const N: usize> { V: K }
    enum E { X, Y { Z: i32 } }
    trait H { type I; const J: i32; fn F(P: i32); }
    type A = i32;
    const B: i32 = 1;
    static C: i32 = 1;
    fn D<'b, L, const O: usize>(P: i32) {
        let (R, S) = (P, 2);
        'c: loop { break 'c; }
    }
    union U { W: i32 }
}
"""
C = """#define M(P, Q) ((P) + (Q))
#define O 1
typedef struct T { int F; } T_t;
enum E { A, B = 2 };
union U { int V; };
int G;
static int H(int I) {
J:
    for (int K = 0; K < 1; K++) {
        int L = K;
    }
    return I;
}
"""
CPP = """#define M(P, Q) ((P) + (Q))
namespace N {
template<class T, int K> using A = T;
class C {
public:
    int F;
    C();
    ~C();
    C& operator=(const C&);
    void G(int H);
private:
    int I_;
};
enum E { J, K };
struct S { int L; };
union U { int V; };
int W;
void X(int Y) {
Z:
    int Q = Y;
    auto [R, B] = std::pair{1, 2};
    auto O = [P = Y](int Q) { return P + Q; };
}
}
"""
NAMES = [
    ("rust", RUST, "M Q V T 'a K N V E X Y Z H I J F P A B C D 'b L O P R S 'c U W"), ("rust", "fn calculate() {\n match None {\n None => {}\n Some(Q) => { let R = Q; }\n }\n}\n", "calculate Q R"),
    ("rust", "fn calculate() { let Velocity = 1; }\n", "calculate Velocity"), ("rust", "extern crate alloc as A;\npub(crate) fn f(&self, (a, B { c, d: e }): T, mut g: u8) { h(|i: Vec<u8>, &j| i | j); if let Some(k) = l && let Ok(m) = n { } m!(let o = 1); }", "A f a c e g i j k m"),
    ("rust", "fn f() { match r { Some(s) if s > t => 1, Kind::One { u } | Kind::Two(u) => { 2 } other @ (3 | 4) => other, RED => 5, } }", "f s u u other"),
    ("c", C, "M P Q O T F T_t E A B U V G H I J K L"), ("cpp", CPP, "M P Q N T K A C F G H I_ E J K S L U V W X Y Q R B O P Q"),
    ("c", "int a, b[3], f(int x), (*g)(void);\ntypedef int (*handler)(int);\nstruct s { int c : 3; struct s *next; };\n", "a b f x g handler s c next"),
    ("c", "#include <a.h>\nint f(int p) { FILE *fp = open(p); x * y; foo(a, b); if ((c = d)) return 1; switch (e) { case 1: int z; } goto out; out: return 0; }", "f p fp y z out"),
    ("c", "EXPORT int API h(void *p, void (*back)(int code)) { struct t u = {.v = 1}; return (int)u; }\nstatic const char *const N[] = {\"a\"};\n", "h p back code u N"),
    ("cpp", "namespace a::b { namespace c = d; inline int e{1}; }\nvoid A::f(int g) { if (auto h = i(); h) {} try { j(); } catch (const E &k) {} for (auto l : m) {} }", "a b c e f g h k l"),
    ("cpp", "template <typename T, template <class> class U, int N = 3> struct S : B<T> { explicit S(int a) : b_{a} {} friend bool operator<(const S &c, const S &d); operator bool() const; T b_; };", "T U N S a c d b_"),
    ("cpp", "auto f(int a) -> std::vector<int> { auto g = [&, h = a]<typename T>(T i) mutable { return i; }; return x(g, [](int j) { int k; }); }", "f a g h T i j k"),
    ("cpp", "std::function<void(int)> f(std::map<int, char> a, int (&b)[3]);\nstd::string c(\"x\");\nint (*d(int e))(char);\n", "f a b c d e"),
    ("cpp", "void f() { Foo x(a); Foo y{a}; Foo z; a.b(c); a::d(e); g<int>(h); delete p; }", "f x y z"),
]


@pytest.mark.parametrize("language,text,expected", NAMES)
def test_names(language, text, expected):
    assert names(text, language) == expected.split()


def test_roles_of_declarators():
    """Const counts at the outermost derivation of each declarator; private is a matter of the access specifier in force."""
    roles = lambda text, language="cpp": {n[1]: n[2] for n in read(text, language).names}
    for language in ("c", "cpp"):
        assert roles("const int *a; const int B = 1, *c = 0; int *const D = 0; void (*e)(int f); const int G[2];", language) == {"a": "variable", "B": "constant", "c": "variable", "D": "constant", "e": "variable", "f": "variable", "G": "constant"}
    assert roles("class A { int b_; static int c; public: int d; private: int e_; void f(int g); }; void h() { int i; }") == {"A": "type", "b_": "private_member", "c": "variable", "d": "variable", "e_": "private_member", "f": "function", "g": "variable", "h": "function", "i": "variable"}
    for kind, role in (("const auto", "constant"), ("auto", "variable"), ("const auto&", "variable"), ("auto&", "variable"), ("const auto&&", "variable")):
        assert roles(f"void f() {{ for ({kind} [a, b] : c) {{}} }}")["a"] == role
    assert roles("struct s { int a; }; typedef int t_t; enum e { X };", "c") == {"s": "tag", "a": "variable", "t_t": "typedef", "e": "tag", "X": "enum_member"}
    assert roles("fn f<'a, T: X, const N: usize>(x: &'a T) { 'b: loop {} }", "rust") == {"f": "function", "'a": "lifetime", "T": "type_parameter", "N": "const_parameter", "x": "variable", "'b": "label"}


SUBJECTS = [
    ("cpp", "class A { public: A(int x); ~A(); bool operator==(const A &) const; operator bool() const; static int f(int, int b); };\ntemplate <typename T> [[noreturn]] void g(T a);\nstatic int h(void) { static int i; return i; }", [
        ("A", "item", [], None, False), ("A", "callable", ["x"], "NoValue", True), ("~A", "callable", [], "NoValue", True), ("operator==", "callable", [], "Value", True), ("operator bool()", "callable", [], "Value", False), ("f", "callable", ["b"], "Value", False),
        ("g", "callable", ["a"], "Never", False), ("h", "callable", [], "Value", False),
    ]),
    ("c", "#define X 1\nint f(int a, ...), *g(void);\nvoid (*h)(int);\nstruct s { int m; };\n", [("X", "item", [], None, False), ("f", "callable", ["a"], "Value", False), ("g", "callable", [], "Value", False), ("s", "item", [], None, False), ("m", "item", [], None, False)]),
    ("rust", "pub struct S(pub u8, u8);\npub trait T { fn f(&self, a: u8) -> !; }\nimpl fmt::Display for S { fn fmt(&self) {} }\nfn g() { fn h() {} }\n", [
        ("S", "item", [], None, False), ("<tuple-field:0>", "item", [], None, False), ("T", "item", [], None, False), ("f", "callable", ["a"], "Never", False), ("fmt", "callable", [], "NoValue", False), ("g", "callable", [], "NoValue", False), ("h", "callable", [], "NoValue", False),
    ]),
]


@pytest.mark.parametrize("language,text,expected", SUBJECTS)
def test_subjects(language, text, expected):
    assert [(s.name, s.kind, s.params, s.shape, s.effect) for s in read(text, language).subjects] == expected


def test_owners_tiers_and_ranges():
    by = {s.name: s for s in read("impl fmt::Display for S { fn fmt(&self) {} }\nimpl S { pub fn a() {} }\npub trait T { fn b(); }\npub(crate) fn c() {}\nfn d() { pub fn e() {} }\n", "rust").subjects}
    assert by["fmt"].owner == "fmt::Display" and by["a"].tier == "public" and by["b"].tier == "public" and by["c"].tier == by["d"].tier == by["e"].tier == "internal"
    text = "int x;\n/* c */ static int f(int a)\n/* between */\n{ return a; }\nint y;\n"
    (f,) = [s for s in read(text, "c").subjects if s.kind == "callable"]
    assert text[f.begin : f.end].startswith("static int f") and text[f.begin : f.end].endswith("return a; }") and f.tier == "internal"


def test_damaged_and_empty_texts_end():
    for language in ("rust", "c", "cpp"):
        for text in ("", "(", ")", "{ { [", "template <", "fn f(", "class A : ", "enum", "operator", "[[", "#define", "'a", "struct", "using =", "for (", "x < y < z", "let |", "match {", "~", "::", "impl <", "use ;"):
            read(text, language)
