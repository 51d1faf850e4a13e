import pytest

from factloom.functions.grammar import syntax_problem

VALID = {
    "python": ["", "def f(a, *, b=1) -> int:\n    return a\n", "x = f'{a!r}'\n", '# <<<<<<< ours\nx = "=======" \n'],
    "rust": [
        "", "pub fn f<'a>(x: &'a str, mut y: f64) -> Vec<Vec<f64>> { let z = if y > 1.0 { 2.0 } else { 3.0 }; vec![z] }\n",
        "use std::io::{self, Read as R};\n#[derive(Debug)]\npub enum E { A, B(u8), C { x: i32 } }\nimpl<T: Clone> Tr for S<T> where T: Copy { fn g(&self) -> Option<u8> { self.x?.y.map(|v| v + 1) } }\n",
        "fn m(x: u8) -> u8 { match x { 0 | 1 => 2, n @ 3..=5 if n > 4 => { n } _ => loop { break 7; } } }\n", "/* a /* nested */ b */ const S: &str = r#\"}\"#;\n",
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nfn f() { let Some(y) = z else { return; }; for (a, b) in y.iter() { println!(\"{}\", a); } }\n",
    ],
    "c": [
        "", "#include <a.h>\n#define F(x) \\\n  do { (void)(x); } while (0)\nstatic const double A[] = {1.0, .5e-3, 0x1fu};\nint f(int a, char *b[], void (*g)(int)) { for (int i = 0; i < 3; ++i) { if (a) continue; else a = (int)b[i][0]; } switch (a) { case 0: return 1; default: break; } return a ? 1 : sizeof(int); }\n",
        "typedef struct node { struct node *next; int v : 3; } node_t;\nenum e { X = 1, Y };\nunion u;\nextern int q;\n", "struct p a = {.x = 1, .y = {2, 3}};\n",
    ],
    "cpp": [
        "namespace a::b {\ntemplate <typename T, int N = 3>\nclass C : public D<T>, private E {\npublic:\n    explicit C(int x) : x_(x), y_{1} {}\n    ~C() override = default;\n    bool operator==(const C &o) const { return x_ == o.x_; }\nprivate:\n    int x_ = 0;\n};\n}\n",
        "auto f(const std::vector<std::pair<int, double>> &v) -> int {\n    auto g = [&](double q) { return q * 2; };\n    for (const auto &[k, w] : v) { g(w); }\n    long n = 1'000'000;\n    const char *s = R\"x(\")\")x\";\n    try { throw E(\"a\"); } catch (const E &e) { return static_cast<int>(n); }\n    return 0;\n}\n",
    ],
}
DAMAGED = {
    "python": ["def f(a:\n    pass\n", "x = 'a\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "int main() { return 0; }\n", "a;b;c\nrow 0;1.2;3 kg\n"],
    "rust": ["fn f( { }\n", "fn f() { let x = ; }\n", "fn f() {\n", "int f(int a) { return a; }\n", 'const S: &str = "a;\n', "fn f() { let mut a 3.0; }\n", "class A:\n    pass\n"],
    "c": ["int f(int a {\n return a; }\n", "int f() { return 1 }\n", "int x = 3 4;\n", "#if A\nint x;\n", "class A { public: int x; };\n", "<!DOCTYPE html>\n<p>x</p>\n", "/* open\nint x;\n", "x = 1\n=======\ny = 2;\n"],
    "cpp": ["class A { public: int x; \n", "double f(double x) { double y = x * ; return y; }\n", "fn f(x: f64) -> f64 { x }\n"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, own in VALID.items() for t in own])
def test_valid(language, text):
    assert syntax_problem(text.encode(), language) is None


@pytest.mark.parametrize("language,text", [(k, t) for k, own in DAMAGED.items() for t in own])
def test_damaged(language, text):
    assert syntax_problem(text.encode(), language)


def test_edges():
    assert syntax_problem(None, "c") is None and syntax_problem(b"x", None) is None
    assert syntax_problem(b"\xff\xfe", "python") == "source is not valid UTF-8"
    assert syntax_problem(("int a" + "[1]" * 20000 + ";\n").encode(), "c") is None
    assert syntax_problem(b"int x = " + b"(" * 3000 + b"1" + b")" * 3000 + b";", "c") is None


REAL = {
    "c": [
        "ZEXTERN int ZEXPORT inflate(z_streamp strm, int flush);\nint x[3] ALIGN8 = {1};\n", "local int bits(struct state *s) { unsigned char FAR *w; UNITTEST_BEGIN(f(&x))\n int n; EXPECT(n, int) }\n",
        "#ifdef A\nint f(int a) {\n#else\nint f(void) {\n#endif\n return 1; }\n", "#if 0\nthis isn't code (\n#endif\nint x;\n", "int f(const char *s, ...) __attribute__((format(printf, 1, 2)));\n__asm__ volatile(\"nop\" : : );\n",
        'int f() { printf("a" \\\n "b"); }\n', "#define each(x) for (;;)\nvoid f() { each(item) { g(); } }\n",
    ],
    "cpp": [
        "export module a.b:part;\nimport std;\nimport <vector>;\nimport \"x.h\";\nexport namespace n { int f(); }\n", "auto f(int a) -> decltype(a + 1) { return (a)->*b; }\nextern \"C\" int g(int x) { return x; }\nenum class E : int { x, y };\n",
        "struct A { operator n::view<char>() const { return v; } template <typename T> A &operator=(T &&) = delete; };\ntemplate <typename... T> bool all(T... t) { return (t && ...); }\ntemplate class X<int>;\n",
        "template <typename T> concept C = requires(T t) { t.x(); };\nTEST(a, namespace) { f(); }\nauto operator\"\"_cf() { return 1; }\n",
    ],
    "rust": [
        "union U { x: u8 }\nfn f() { let union = 3; if a && let Some(x) = y && b { } }\n", "a::b!(|x: &str| { y });\ntrait T { type S: U<Ok = Self::Ok>; }\nfn g() { h(0., [1.; 3]); }\n",
        "/*a/*b/*c/*d/*e*/*/*/*/*/ fn f() { let x = r#####\"a\"#### \"b\"#####; }\n",
    ],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, own in REAL.items() for t in own])
def test_macros_conditions_and_modules(language, text):
    """Macros of other files, one branch of a condition at a time, and words that are keywords by their place."""
    assert syntax_problem(text.encode(), language) is None


@pytest.mark.parametrize("language,text,at", [("rust", "fn f() {}\nfn g( { }\n", 14), ("rust", "fn f() {}\nstruct {}\n", 10), ("c", "int x;\nint y = ;\n", 7), ("c", "#if A\nint x;\n", 0), ("cpp", "int a;\n}\n", 7), ("c", "int f() {\n return 1 }\n", 8)])
def test_place_of_damage(language, text, at):
    from factloom.functions.grammar import damage_offset

    assert syntax_problem(text.encode(), language) and damage_offset(text, language) == at


def test_python_by_the_stack():
    """The stacks of brackets and indents and the grammar of lines judge Python by themselves; the interpreter only confirms."""
    from factloom.functions import grammar

    def damaged(text):
        shape, reason = grammar._python_shape(text)
        return reason or (grammar._BAD in shape and "unterminated literal or stray character") or (grammar._reduced(shape, "python", False) or (None,))[0]

    valid = [
        "", "\n# c\n", "x = 1", "def f(a, /, b: int = 1, *c, d, **e) -> list[int]:\n    '''doc'''\n    return a if b else c[1:2, ::3]\n", "@d(1)\nclass A(B, metaclass=C):\n    x: int = 1\n\n    async def f(self):\n        async with a as b, c:\n            yield await d\n",
        "if x:\n    pass\nelif y: z = 1; w = 2\nelse:\n\tfor a, *b in c: print(a, *b, **d)\n", "try:\n    import a.b as c\nexcept (A, B) as e:\n    raise C from e\nelse:\n    pass\nfinally:\n    del x[0], y\n",
        "x = {**a, 'b': 1, 'c': lambda q=1, *r: (q, r)}\ny = [i for j in k if l for i in j]\nz = {m for m in n}\n", "match x:\n    case A(b=1) as c if c > 2:\n        pass\n    case [1, *_] | {'k': v}:\n        pass\n", "with (open(a) as b, open(c) as d):\n    pass\n",
        "x = a \\\n    + b\nassert x, 'y'\nglobal z\nif (n := 10) > 5: pass\n", "type X[T] = list[T]\ndef f[T](x: T): ...\nprint(f'{x!r:>{w}}' 'y')\nx, y = y, x\na = b = yield\n", "for x in a, b:\n    continue\nwhile not x is not y:\n    break\nelse:\n    pass\n",
    ]
    broken = [
        "x = (1\n", "x = 1)\n", "x = 'a\n", "def f(:\n    pass\n", "if x:\nprint(1)\n", "  x = 1\ny = 2\n", "x = = 1\n", "class A\n    pass\n", "fn f() -> u8 { 1 }\n", "#include <a.h>\nint main(void) {\n  return 0;\n}\n",
        "x = 1\n<<<<<<< HEAD\ny = 2\n=======\ny = 3\n>>>>>>> b\n", "def f():\n    return 1 +\n", "for x y:\n    pass\n", "x = [1, 2\ny = 3\n", "def f():\n", "import\n", "if x:\n        a\n    b\n", "x = 12abc\n", "this is no code.\n",
    ]
    for text in valid:
        assert not damaged(text) and syntax_problem(text.encode(), "python") is None, text
    for text in broken:
        assert damaged(text) and syntax_problem(text.encode(), "python") == damaged(text) or "merge" in syntax_problem(text.encode(), "python"), text
