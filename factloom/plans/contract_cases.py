"""The engine's own rules over small sources whose results its contract states: queries with their expected rows as SQL.

The queries read no stored table; they run the observer and the rule plan over the sources below, so the rows stand for the rules themselves.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.observe import observe
from factloom.plans import review
from factloom.sources.authority import Authority, Rejection, admit

_PY = """class X:
    Q: int = 1

    def f(self, T, /, *, V=1):
        K, *N = (T, V)
        self.W = K
        other.Z = W
        for I in K:
            pass
        with open("input") as H:
            pass
        try:
            pass
        except Exception as E:
            pass
"""
_PY_GENERICS = """type A[T] = tuple[T]
class C[T]:
    def F[U](self, V):
        G = lambda H: H
        import package as I
        match V:
            case J:
                return J
        return G(V)
"""
_RUST = """macro_rules! M { () => {} }
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
_C = """#define M(P, Q) ((P) + (Q))
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
_CPP = """#define M(P, Q) ((P) + (Q))
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
#: Sources and the names they declare, in order; a receiver is a declaration that is not judged.
NAMES = (
    ("subjects.py", _PY, "X Q f T V K N W I H E"), ("generics.py", _PY_GENERICS, "A T C T F U V G H I J"),
    ("subjects.rs", _RUST, "M Q V T 'a K N V E X Y Z H I J F P A B C D 'b L O P R S 'c U W"), ("variants.rs", "fn calculate() {\n    match None {\n        None => {}\n        Some(Q) => { let R = Q; }\n    }\n}\n", "calculate Q R"),
    ("subjects.c", _C, "M P Q O T F T_t E A B U V G H I J K L"), ("subjects.cpp", _CPP, "M P Q N T K A C F G H I_ E J K S L U V W X Y Q R B O P Q"),
    ("range.cpp", "void calculate_distance() { int distance_m[2]; for (int BadName : distance_m) {} }", "calculate_distance distance_m BadName"),
    ("bindings.cpp", "void calculate_distance() { int distance_m[2][2]; for (auto &[BadName, OtherName] : distance_m) {} }", "calculate_distance distance_m BadName OtherName"),
    ("structured.cpp", "void calculate_distance() { int distance_m[2]; auto [BadName, OtherName] = distance_m; }", "calculate_distance distance_m BadName OtherName"),
    ("headers.cpp", "void calculate_distance() { if (int BadName = 1) {} while (int OtherName = 1) {} }", "calculate_distance BadName OtherName"),
)

_DISPLAY = "impl fmt::Display for Velocity {{\n    /// 计算展示文本\n    fn {0}(&self, formatter: &mut fmt::Formatter<'_>) -> fmt::Result {{\n        formatter.write_str(\"velocity\")\n    }}\n}}\n"
_OPERATOR = """struct Velocity {{}};
/**
 * 比较速度值
 *
 * 参数：
 * - left_value：  左侧速度值
 * - right_value： 右侧速度值
 * 返回：
 * - 比较结果
 * 错误：
 * - 无
{0} */
bool operator==(const Velocity &left_value, const Velocity &right_value);
"""
_TEMPLATE = """/**
 * 计算抽样速度
 *
 * 模板参数：
 * - ValueType：    输入数值类型
{0} * 参数：
 * - input_value：  输入数值
 * - sample_count： 抽样次数
 * 返回：
 * - 平均速度
 * 错误：
 * - 无
 */
template <typename ValueType, int SAMPLE_COUNT>
double calculate_velocity(ValueType input_value, int sample_count);
"""
_CLASS = """class VelocityCalculator {{
public:
    /**
     * 初始化速度计算器
     *
     * 参数：
     * - 无
     * 返回：
     * - 无
     * 错误：
     * - 无
     * 效果：
     * - 初始化计算器状态
     */
    VelocityCalculator();

    /**
     * 销毁速度计算器
     *
     * 参数：
     * - 无
     * 返回：
     * - 无
     * 错误：
     * - 无
{0}     */
    ~VelocityCalculator();
}};
"""
_HARD = "identifier hard"
#: Sources and the findings the contract states for them as ``rule:line`` (all findings of the family named by the prefix before the path's slash).
FINDINGS = (
    ("placement/named.cpp", "module;\nexport module velocity;\nexport import math;\n", ""), ("placement/header.cpp", "export module velocity;\nimport <vector>;\n", ""),
    ("placement/global.cpp", "module;\nimport math;\n", "dependency.module_placement:2"), ("placement/misplaced.cpp", "int value;\nimport math;\n", "dependency.module_placement:2"),
    ("placement/nested.cpp", "namespace detail { import math; }\n", "dependency.module_placement:1"), ("placement/private.cpp", "module :private;\nimport math;\n", "dependency.module_placement:2"),
    ("placement/a.cpp", "export module value;\nexport\n/* explanation */\nimport math;\n", ""), ("placement/b.cpp", "export\n/* explanation */\nmodule value;\nimport math;\n", ""),
    ("placement/c.cpp", "module;\n#if ENABLED\nimport math;\n#endif\nimport other;\n", "dependency.module_placement:3 dependency.module_placement:5"),
    ("placement/d.cpp", "module;\n#define ENABLED 1\nimport math;\n", "dependency.module_placement:3"), ("placement/e.cpp", "// explanation\nexport module value;\nimport math;\n", ""),
    ("placement/f.cpp", "export module value;\nimport first;\n/* explanation */\nimport second;\n", ""),
    ("placement/g.cpp", "#if ENABLED\nimport math;\n#elif OTHER\nimport other;\n#else\nimport fallback;\n#endif\n", ""), ("placement/h.cpp", "int value;\n#if ENABLED\nimport math;\n#endif\n", "dependency.module_placement:3"),
    ("placement/i.cpp", "#if ENABLED\nnamespace detail { import math; }\n#endif\n", "dependency.module_placement:2"), ("placement/j.cpp", "module;\n#if ENABLED\nexport module value;\n#endif\nimport math;\n", ""),
    ("placement/k.cpp", "module;\n#if ENABLED\nimport math;\nexport module value;\n#endif\n", "dependency.module_placement:3"), ("placement/l.cpp", "#if ENABLED\nint value;\nimport math;\n#endif\n", "dependency.module_placement:3"),
    ("placement/m.cpp", "#if ENABLED\nint value;\n#else\nimport math;\n#endif\nimport other;\n", ""), ("placement/n.cpp", "#if ENABLED\nint value;\n#elif OTHER\nimport math;\n#else\nimport other;\n#endif\n", ""),
    ("placement/o.cpp", "#ifdef ENABLED\nint value;\nimport math;\n#else\nimport other;\n#endif\n", "dependency.module_placement:3"), ("placement/p.cpp", "#if ENABLED\nint value;\n#else\nint other;\n#endif\nimport math;\n", "dependency.module_placement:6"),
    ("placement/q.cpp", "#if ENABLED\nint value;\n#endif\nimport math;\n", ""), ("placement/r.cpp", "module;\n#if ENABLED\nexport module value;\n#else\nimport math;\n#endif\nimport other;\n", "dependency.module_placement:5"),
    ("placement/s.cpp", "#if ENABLED\nmodule;\n#else\nint value;\n#endif\nimport math;\nexport module value;\nimport other;\n", "dependency.module_placement:6"),
    ("placement/t.cpp", "#if ENABLED\nint value;\n#if OTHER\nimport math;\n#endif\n#endif\n", "dependency.module_placement:4"), ("placement/u.cpp", "#if ENABLED\nimport math;\nint value;\n#endif\n", ""),
    ("placement/v.cpp", "#if ENABLED\n#define VALUE 1\nimport math;\n#endif\n", ""),
    ("imports/list.rs", "use crate::{\n    beta,\n    /* explanation */ alpha,\n};\n", "dependency.order:3"), ("imports/wildcard.rs", "use crate::{beta, alpha, *};\n", "dependency.order:1 dependency.wildcard:1"),
    ("imports/unknown.rs", "use $first;\nuse crate::{zeta, alpha};\nuse $second;\n", "dependency.order:2"), ("imports/member.rs", "use crate::{zeta, $unknown, alpha};\n", ""),
    ("imports/partial.rs", "use zeta;\nuse crate::{zeta, alpha, $unknown};\nuse alpha;\n", "dependency.order:2"), ("imports/neighbours.rs", "use std::b;\nuse std::a;\n", "dependency.order:2"),
    ("imports/kinds.rs", "use self::a;\nuse super::a;\nuse crate::a;\nuse a::b2;\nuse a::b10;\nuse a::b10::c;\nuse a::{x};\n", ""), ("imports/sorted.py", "import os\nimport sys\n\nimport numpy\n", ""),
    ("imports/unsorted.py", "import sys\nimport os\n", "dependency.order:2"),
    ("imports/star.c", "#include \"*\"\n", ""), ("imports/star.cpp", "#include \"*\"\n", ""), ("imports/glob.rs", "use crate::module::*;\n", "dependency.wildcard:1"), ("imports/groups.py", "import sys\nvalue = 1\nimport os\n", ""),
    ("imports/groups.rs", "use zeta::module;\nmod inner { use alpha::module; }\n", ""), ("imports/modules.rs", "use zeta::module;\nuse alpha::module;\n", "dependency.order:2"), ("imports/spacing.py", "import os\n\nimport sys\n", "dependency.order:3"),
    ("imports/tiers.py", "import os\nimport numpy\n", "dependency.order:2"), ("imports/tie.rs", "use alpha1::module;\nuse alpha01::module;\n", "dependency.order:2"), ("imports/roots.rs", "use alpha::module;\npub(crate) use self::module;\n", "dependency.order:2"),
    *((f"imports/evidence_{k}.py", source, " ".join(f"dependency.order:{n}" for n in lines)) for k, (source, lines) in enumerate((
        ("import sys\nimport os\nimport unknown\n", (2,)), ("import unknown\nimport sys\nimport os\n", (3,)), ("import sys\nimport unknown\nimport os\n", ()), ("import sys\nimport os, numpy\nimport os\n", (2, 3)), ("import sys\nimport os\nimport os, numpy\n", (2,)),
        ("import sys\nimport os\ndef _value():\n    import unknown\n", (2,)), ("import sys\ndef _value():\n    import unknown\nimport os\n", ()), ("import unknown\nif TYPE_CHECKING:\n    import sys\n    import os\n", (4,)), ("import unknown\nimport os\nimport numpy\n", (3,)),
        ("def _load():\n    import sys, first_missing as missing, os\n    import second_missing, sys, os\n", (3,)),
    ))), ("imports/star.py", "from project import *\n", "dependency.wildcard:1"),
    ("names/invalid.py", "velocity = 1\nclass calculate_velocity:\n    def Velocity(self, Distance_velocity):\n        Q = Distance_velocity\n        return Q\n", f"{_HARD} 4"),
    ("names/invalid.rs", "struct calculate_velocity;\nconst velocity: f64 = 1.0;\nenum Distance { VELOCITY }\nfn Velocity(distance_m: f64) { let Q = distance_m; }\n", f"{_HARD} 4"),
    ("names/invalid.c", "typedef int Velocity;\nenum distance { velocity };\ndouble Velocity(double distance_m);\nint _Velocity;\nint __velocity;\nint _velocity;\nint Q;\n", f"{_HARD} 6"),
    ("names/invalid.cpp", "class calculate_velocity { public: double velocity_; private: static double distance_; double velocity_m_per_s_; };\nenum Distance { velocity };\ndouble Velocity(double distance_m);\nint _Velocity;\nint velocity__distance;\nint _velocity;\nint Q;\n", f"{_HARD} 8"),
    *((f"names/{k}.cpp", f"static void calculate_distance() {{ int distance_m[2][2] = {{{{1, 2}}, {{3, 4}}}}; for ({kind} [{names}] : distance_m) {{}} }}", f"{_HARD} {n}") for k, (kind, names, n) in enumerate((
        ("const auto", "DISTANCE_M, DURATION_S", 0), ("const auto", "distance_m, duration_s", 2), ("auto", "distance_m, duration_s", 0), ("auto", "DISTANCE_M, DURATION_S", 2), ("const auto&", "distance_m, duration_s", 0), ("auto&", "distance_m, duration_s", 0),
    ))),
    ("names/pointer.c", "const int *distance_m;\nconst int DISTANCE_M = 1, *duration_s = 0;\nint *const DISTANCE_M = 0;\nvoid (*calculate_distance)(int distance_m);\n", f"{_HARD} 0"), ("names/constant.c", "int *const distance_m = 0;\n", f"{_HARD} 1"),
    ("owners/trait.rs", "struct Velocity {\n    distance_m: f64,\n}\n\n" + _DISPLAY.format("fmt"), ""), ("owners/free.rs", "/// 计算展示宽度\nfn fmt(distance_m: f64) -> f64 {\n    distance_m\n}\n", "identifier.unknown_token:2"),
    ("owners/short.rs", _DISPLAY.format("x"), "identifier.candidate:3"), ("owners/form.rs", _DISPLAY.format("BadName"), "identifier.canonical_form:3"), ("owners/raw.rs", _DISPLAY.format("r#type"), "identifier.reserved:3"),
    *((f"carriers/literal_{k}.rs", f"{attribute}\nfn calculate_velocity() {{}}\n", "") for k, attribute in enumerate((
        '#[doc = "计算数值"]', '#[doc = r"计算数值"]', '#[doc = r###"计算数值"###]', '#[doc = "\\u{8ba1}\\u{7b97}数值"]', '#[doc = "计算数值\\x20"]', '#[doc = "计算\\\n    数值"]', '#[doc = "计算数值\\n"]',
    ))),
    *((f"carriers/mixed_{k}.rs", f"{prefix}fn calculate_velocity() {{}}\n", "") for k, prefix in enumerate((
        '/// 计算数值\n#[doc = ""]\n', '#[doc = "计算数值"]\n///\n', '/** 计算数值 */\n#[doc = ""]\n', '/// 计算数值\n#[inline]\n#[doc = ""]\n/// 补充说明\n', "/// 计算数值\n// 附着说明\n", '#[doc = "计算数值"]\n/* 附着说明 */\n', '/// 计算数值\n#[doc = include_str!("missing.md")]\n',
    ))),
    *((f"carriers/none_{k}.rs", f"{prefix}fn calculate_velocity() {{}}\n", f"documentation.carrier:{prefix.count(chr(10)) + 1}") for k, prefix in enumerate((
        "// 普通说明\n", "/* 普通说明 */\n", "//// 普通说明\n", "/// 前方摘要\n//! 内层文档\n", "/// 前方摘要\n/*! 内层文档 */\n", "//! 计算数值\n",
    ))),
    ("carriers/separate.rs", '/// 计算数值\nfn value() {}\n#[doc = ""]\nfn calculate_velocity() {}\n', "documentation.summary:4"),
    ("effects/operator.cpp", _OPERATOR.format(" * 效果：\n * - 比较两个速度值\n"), ""), ("effects/operator_none.cpp", _OPERATOR.format(""), "documentation.public_contract:13"), ("effects/operator_empty.cpp", _OPERATOR.format(" * 效果：\n * - 无\n"), "documentation.public_contract:15"),
    ("effects/operator_twice.cpp", _OPERATOR.format(" * 效果：\n * - 比较两个速度值\n * 效果：\n * - 比较两个速度值\n"), "documentation.public_contract:17"),
    ("effects/template.cpp", _TEMPLATE.format(" * - SAMPLE_COUNT： 抽样次数类型\n"), ""), ("effects/template_missing.cpp", _TEMPLATE.format(""), "documentation.public_contract:15"),
    ("effects/class.cpp", _CLASS.format("     * 效果：\n     * - 释放计算器状态\n"), ""), ("effects/class_missing.cpp", _CLASS.format(""), "documentation.public_contract:27"),
    ("damage/open.rs", "fn f() {}\nfn g( { }\n", "source.parseability:2"), ("damage/value.c", "int x;\nint y = ;\n", "source.parseability:2"), ("damage/module.cpp", "export module value;\nexport class Velocity {};\nint value() { return 1 }\n", "source.parseability:3"),
)

_FAMILY = {"placement": "dependency.module_placement", "imports": "dependency.", "names": "identifier.", "owners": "identifier.", "carriers": "documentation.", "effects": "documentation.public_contract", "damage": "source.parseability"}
_WORDS = "beta alpha calculate velocity value distance duration formatter left right input sample count calculator display other inner before".split()
AUTHORITY = Authority(
    public_callables=tuple((f"effects/{f}.cpp", n) for f, names in (("operator", "operator=="), ("operator_none", "operator=="), ("operator_empty", "operator=="), ("operator_twice", "operator=="), ("template", "calculate_velocity"), ("template_missing", "calculate_velocity"), ("class", "VelocityCalculator ~VelocityCalculator"), ("class_missing", "VelocityCalculator ~VelocityCalculator")) for n in names.split()),
    listed_paths=tuple(f"effects/{f}.cpp" for f in ("operator", "operator_none", "operator_empty", "operator_twice", "template", "template_missing", "class", "class_missing")),
    token_vocabulary=tuple(_WORDS), quantity_concepts=(("distance", "m"), ("distance", "mm"), ("duration", "s"), ("velocity", "m_per_s")),
    external_fixed_identifiers=tuple(("rust", "function", "fmt::Display", x) for x in ("fmt", "x", "BadName", "r#type")),
    dependency_classes=(("numpy", "third_party"), ("os", "standard"), ("project", "project"), ("sys", "standard")), python_reorder_safe=True, rust_reorder_safe=True,
)


def declared_names(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, pos, name)``: names that the sources of NAMES declare (B7 to B10, B12), receivers left out."""
    documents = spark.createDataFrame([(path, bytearray(source.encode())) for path, source, _ in NAMES], "relative_path string, content binary")
    rows = review.facts(documents, Authority()).filter("fact = 'name' and role <> 'receiver'").select("path", "line", "column_no", F.col("subject").alias("name"))
    ordered = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "column_no", "name"))).alias("n"))  # a dozen short sources
    return ordered.select("path", F.posexplode("n").alias("pos", "n")).select("path", F.col("pos").cast("bigint").alias("pos"), "n.name")


def _results(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    documents = spark.createDataFrame([(path, bytearray(source.encode())) for path, source, _ in FINDINGS], "relative_path string, content binary")
    table = review.checkpointed(review.facts(documents, AUTHORITY))
    subjects = review._subjects(table, AUTHORITY)
    rules = review.source_rules(table).unionByName(review.identifier_rules(table, AUTHORITY)).unionByName(review.documentation_rules(subjects)).unionByName(review.dependency_rules(table, AUTHORITY))
    return rules, review.coverage(table, subjects, AUTHORITY)


def rule_findings(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, rule, line)``: findings of the rule family that each source of FINDINGS is about; name forms as a count of hard ones."""
    family = F.substring_index("path", "/", 1)
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in _FAMILY.items() for x in pair]), family)
    found = _results(spark)[0].select("path", "rule", "grade", "line", wanted.alias("wanted")).filter(F.col("rule").startswith(F.col("wanted")))
    listed = found.filter("path not like 'names/%'").select("path", "rule", F.col("line").cast("bigint").alias("line"))
    hard = found.filter("path like 'names/%' and grade = 'hard_violation'").groupBy("path").agg(F.count(F.lit(1)).alias("line"))
    return listed.unionByName(hard.select("path", F.lit(_HARD).alias("rule"), "line"))


def _values(rows) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def _expected():
    for path, _, stated in FINDINGS:
        if stated.startswith(_HARD):
            if int(stated[len(_HARD) :]):
                yield path, _HARD, int(stated[len(_HARD) :])
        else:
            for one in stated.split():
                rule, line = one.split(":")
                yield path, rule, int(line)


_PY_RETURN = """def calculate_totals(duration_s: float){0}:
    \"\"\"
    计算汇总结果

    Args:
        duration_s: 持续时间
    Returns:
{1}    Raises:
        无
    \"\"\"
    return duration_s
"""
_RUST_RETURN = """/// 计算汇总结果
///
/// # Arguments
/// - duration_s： 持续时间
/// # Returns
{1}/// # Errors
/// - 无
pub fn calculate_totals(duration_s: f64){0} {{
    todo()
}}
"""
_NATIVE_RETURN = """/**
 * 计算汇总结果
 *
 * 参数：
 * - 无
 * 返回：
{1} * 错误：
 * - 无
 */
{0};
"""
_CONVERSION = "/**\n * 表示速度值\n */\nclass Velocity {\npublic:\n    /**\n     * 转换为布尔状态\n     *\n     * 参数：\n     * - 无\n     * 返回：\n     * - 是否处于有效状态\n     * 错误：\n     * - 无\n     */\n    operator bool() { return true; }\n};\n"
_VALUE, _NONE, _BROKEN = " * - 汇总结果值\n", " * - 无\n", "documentation.public_contract"
#: Sources with a return surface and an entry, and what the contract says of the pair: clean, blocked or the rule.
RETURNS = (
    *((f"returns/{k}.py", _PY_RETURN.format(f" -> {surface}" if surface else "", f"        {entry}\n"), outcome) for k, (surface, entry, outcome) in enumerate((
        ("list[float]", "list[float]: 汇总结果序列", "clean"), ("dict[str, int]", "dict[str, int]: 汇总结果映射", "clean"), ("MyAlias", "MyAlias: 汇总别名结果", "clean"), ("MyAlias", "无", _BROKEN), ("None", "value: 数值描述", _BROKEN), ("None", "无", "clean"),
        ("", "无", "blocked"), ("NoReturn", "NoReturn: 永不正常返回", _BROKEN), ("NoReturn", "无", _BROKEN), ("typing.NoReturn", "typing.NoReturn: 永不正常返回", _BROKEN), ("Never", "Never: 永不正常返回", _BROKEN), ("typing.Never", "typing.Never: 永不正常返回", _BROKEN),
    ))),
    *((f"returns/{k}.rs", _RUST_RETURN.format(f" -> {surface}" if surface else "", f"/// - {entry}\n"), outcome) for k, (surface, entry, outcome) in enumerate((
        ("", "无", "clean"), ("()", "无", "clean"), ("Vec<f64>", "汇总结果序列", "clean"), ("Vec<f64>", "无", _BROKEN), ("()", "汇总结果值", _BROKEN), ("answer!()", "汇总结果值", "blocked"), ("!", "无", _BROKEN), ("!", "不返回", "clean"),
    ))),
    *((f"returns/{k}.c", _NATIVE_RETURN.format(f"{surface}calculate_totals(void)", entry), outcome) for k, (surface, entry, outcome) in enumerate((
        ("_Noreturn void ", _NONE, _BROKEN), ("[[noreturn]] int ", _NONE, _BROKEN), ("MyResult ", _VALUE, "clean"), ("MyResult ", _NONE, _BROKEN), ("void ", _VALUE, _BROKEN), ("unsigned ", _VALUE, "clean"), ("void *", _VALUE, "clean"), ("noreturn void ", _NONE, "clean"),
    ))),
    *((f"returns/{k}.cpp", _NATIVE_RETURN.format(declaration, entry), outcome) for k, (declaration, entry, outcome) in enumerate((
        ("auto calculate_totals() -> void", _NONE, "clean"), ("auto calculate_totals() -> int", _VALUE, "clean"), ("auto calculate_totals() -> int", _NONE, _BROKEN), ("auto calculate_totals() -> void", _VALUE, _BROKEN), ("auto calculate_totals()", _VALUE, "blocked"),
        ("[[noreturn(1)]] void calculate_totals()", _NONE, "clean"), ("decltype(auto) calculate_totals()", _VALUE, "blocked"), ("[[noreturn]] void calculate_totals()", _NONE, _BROKEN), ("[[vendor::noreturn]] void calculate_totals()", _NONE, "clean"),
    ))),
    ("returns/conversion.cpp", _CONVERSION, "clean"),
)

_MARKS = (("py", "#"), ("rs", "//"), ("c", "//"), ("cpp", "//"))
_PROSE = (
    ("计算距离。", "source.comment_punctuation", 1), ("计算距离。再计算时间", "source.comment_punctuation", 1), ("Calculate distance.", "source.comment_punctuation", 1), ("Calculate distance. Then return", "source.comment_punctuation", 1),
    ("计算距离（附加说明）", "source.comment_parentheses", 1), ("计算距离(additional explanation)", "source.comment_parentheses", 1), ("数组形状(B,C,H,W)", "source.comment_parentheses", 1),
    ("计算距离并返回结果", None, 0), ("采用 v3.0.0 与 1.25 进行计算", None, 0), ("参见 https://example.org/guide 与 src/model.rs", None, 0), ("使用 `calculate_distance(1.25)` 与 `（。）`", None, 0), ("参见 [调用说明](https://example.org/guide)", None, 0),
    ("```text\n示例内容。Calculate distance. (B,C,H,W)\n```", None, 0), ("~~~~text\n示例内容。（附加说明）\n~~~~", None, 0),
    ("```text\n示例内容。（附加说明）\n```\n仍需检查。", "source.comment_punctuation", 4), ("`未配对的技术标记。", "source.comment_punctuation", 1), ("``未配对的技术标记。`", "source.comment_punctuation", 1), ("```call()``` 这里是正文。", "source.comment_punctuation", 1),
)
#: Comments of each language and the one finding they give, if any; and sources without any.
PROSE = (
    *((f"prose/{k}.{e}", "".join(f"{mark} {line}\n" for line in body.split("\n")), rule, line) for e, mark in _MARKS for k, (body, rule, line) in enumerate(_PROSE)),
    *((f"prose/block.{e}", "/*\n * ```text\n * 示例内容。（附加说明）\n * ```\n */\n", None, 0) for e in ("rs", "c", "cpp")),
    ("prose/indented.rs", "/*\n    println!(\"说明。\");\n*/\n", None, 0), ("prose/literal.py", "distance_m = '# 文本。 (字符串)'\n", None, 0), ("prose/literal.rs", "const DISTANCE_M: &str = \"// 文本。 (字符串)\";\n", None, 0),
    ("prose/literal.c", "const char *distance_m = \"// 文本。 (字符串)\";\n", None, 0), ("prose/literal.cpp", "const char *distance_m = R\"(// 文本。 (字符串))\";\n", None, 0), ("prose/directive.py", "distance_m = 1 # pyright: ignore[report_error.1]\n", None, 0),
    ("prose/directive.c", "double distance_m = 1; // NOLINT(readability.magic)\n", None, 0), ("prose/trailing.py", "distance_m = 1 # 距离\n", "source.trailing_comment", 1), ("prose/trailing.rs", "const DISTANCE_M: f64 = 1.0; // 距离\n", "source.trailing_comment", 1),
)

_FIXED = '{{"schema_version": 4, "external_fixed_identifiers": [{{"profile": "rust", "role": "function", "owner": "Trait<\'{0}>", "spelling": "format_value"}}]}}'
_QUANTITY = '{{"schema_version": 4, "quantity_concepts": {0}}}'
_ROOTS = '{{"schema_version": 4, "dependency_authority": {{"python_project_roots": [{0}]}}}}'
#: Project facts as raw text and the code of their rejection, or ``admitted``.
ADMISSION = (
    ('{"schema_version": 3}', "authority.version"), ('{"schema_version": 4, "rules": null}', "authority.syntax"), ("{", "authority.syntax"), ('{"schema_version": 4, "token_vocabulary": ["a"], "token_vocabulary": []}', "authority.syntax"),
    ('{"schema_version": 4}', "admitted"), ('{"schema_version":4,"header_languages":{"src/a.h":"rust"}}', "authority.header_language"), ('{"schema_version":4,"header_languages":{"src/a.h":"c","src\\\\a.h":"c"}}', "authority.path"),
    *((_QUANTITY.format(q), "authority.quantity") for q in ('{"":["rad"]}', '{"phase offset":["rad"]}', '{"phase":[]}', '{"phase":["rad","rad"]}', '{"Phase":["rad"]}', '{"phase":["RAD"]}', '{"phase":["rad "]}', '{"_phase":["rad"]}', '{"phase_":["rad"]}', '{"phase__offset":["rad"]}', '{"phase":["_rad"]}', '{"phase":["rad_"]}', '{"phase":["m__s"]}', '{"phase":["2m"]}', '{"phase":["m2s"]}', '{"phase":["rad"],"phase_rad":["deg"]}')),
    (_QUANTITY.format('{"acceleration": ["m_per_s2"]}'), "admitted"),
    *((_FIXED.format(n), "admitted") for n in "value static _ union async await dyn try gen".split()), *((_FIXED.format(n), "authority.external_fixed") for n in "self Self crate super fn for type".split()),
    *((_ROOTS.format(json.dumps(n)), "admitted") for n in ("数据", "℘", "a\u0301", "match", "case", "type", "_vendor")),
    *((_ROOTS.format(json.dumps(n)), "authority.dependency") for n in ("class", "async", "await", "True", "None", "a.b", "a, b", "a as b", "a#comment", "a\nimport b", "a\\\n", " a", "a ", "a\u200b", "\u0301a", "7zip", "", "a;", "a\0")),
    ('{"schema_version": 4, "dependency_authority": {"python_standard_library": ["shared"], "python_third_party": ["shared"]}}', "authority.dependency"),
)


def _reviewed(spark: SparkSession, sources, authority: Authority) -> tuple[DataFrame, DataFrame]:
    documents = spark.createDataFrame([(path, bytearray(source.encode())) for path, source, *_ in sources], "relative_path string, content binary")
    table = review.checkpointed(review.facts(documents, authority))
    subjects = review._subjects(table, authority)
    return review.source_rules(table).unionByName(review.documentation_rules(subjects)), review.coverage(table, subjects, authority)


def return_shapes(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, outcome)``: whether return surface and entry of each source agree (B16, C12): clean, blocked, or the rule broken."""
    paths = [path for path, _, _ in RETURNS if not path.endswith((".py", ".rs"))]
    names = {path: ("Velocity", "operator bool()") if path.endswith("conversion.cpp") else ("calculate_totals",) for path in paths}
    authority = Authority(public_callables=tuple((p, n) for p in paths for n in names[p]), listed_paths=tuple(paths))
    findings, cells = _reviewed(spark, RETURNS, authority)
    broken = findings.filter("rule like 'documentation.%' and grade = 'hard_violation'").select("path", "rule").distinct()
    documentation = cells.filter("family = 'documentation'").select("path", "state", "reason")
    returned = F.when((F.col("state") == "blocked") & F.col("reason").contains("[return]"), "blocked").when(F.col("state") == "blocked", F.col("reason"))
    return documentation.join(broken, "path", "left").select("path", F.coalesce("rule", returned, F.lit("clean")).alias("outcome"))


def comment_prose(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, rule, line)``: findings in ordinary comments (B4 to B6, C2 to C4): stops, parentheses and comments behind code, code left out."""
    return _reviewed(spark, PROSE, Authority())[0].filter("rule like 'source.%'").select("path", "rule", F.col("line").cast("bigint").alias("line"))


def admission_codes(spark: SparkSession, directory: str) -> DataFrame:
    """``(pos, code)``: admission of raw project facts."""

    @F.pandas_udf("string")
    def code(raw):
        import pandas as pd

        out = []
        for text in raw:
            try:
                admit(text)
                out.append("admitted")
            except Rejection as e:
                out.append(e.code)
        return pd.Series(out)

    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(ADMISSION)], "pos bigint, raw string")
    return rows.select("pos", code("raw").alias("code"))


_ENUM = "from enum import Enum\nclass Direction(Enum):\n    "
_MEMBER = "from enum import Enum, member\nclass Direction(Enum):\n    "
#: Python sources, a subject, and whether its native role is proven (no form is broken), disproven (the rule), or unresolved (blocked).
ROLES = tuple((f"roles/{k}.py", *row) for k, row in enumerate((
    ("from typing import TypeAlias as Declaration\nFieldValue: Declaration = int\n", "FieldValue", "proven"), (_MEMBER + "@member\n    def LEFT():\n        return 1\n", "LEFT", "proven"), ("from enum import Enum, nonmember\nclass Direction(Enum):\n    left = nonmember(1)\n", "left", "proven"),
    (_ENUM + "@staticmethod\n    def lower_name():\n        return 1\n", "lower_name", "proven"), ("from enum import Enum, member as staticmethod\nclass Direction(Enum):\n    @staticmethod\n    def LEFT():\n        return 1\n", "LEFT", "proven"), (_ENUM + "@classmethod\n    def lower_name(cls):\n        return 1\n", "lower_name", "proven"),
    ("from enum import Enum, member as property\nclass Direction(Enum):\n    @property\n    def LEFT():\n        return 1\n", "LEFT", "proven"), (_ENUM + "@property\n    def lower_name(self):\n        return 1\n", "lower_name", "proven"), ("from enum import Enum, nonmember\nclass Direction(Enum):\n    @nonmember\n    def lower_name():\n        return 1\n", "lower_name", "proven"),
    ("TypeAlias = int\nFieldValue: TypeAlias = 1\n", "FieldValue", "identifier.canonical_form"), (_ENUM + "LEFT = 1\n", "LEFT", "proven"), ('from typing import TypeVar\n_FieldValue = TypeVar("_FieldValue")\n', "_FieldValue", "proven"), ("import ctypes\nclass MemoryStatus(ctypes.Structure):\n    _fields_ = []\n", "_fields_", "proven"),
    ("from enum import IntFlag as Options\nclass Direction(Options):\n    LEFT = 1\n", "LEFT", "proven"), ("import enum as choices\nclass Direction(choices.StrEnum):\n    LEFT = 'left'\n", "LEFT", "proven"), ('from typing import TypeVar as Parameter\n_FieldValue = Parameter("_FieldValue")\n', "_FieldValue", "proven"),
    ('import typing as types\n_FieldValue = types.TypeVar("_FieldValue")\n', "_FieldValue", "proven"), ("from ctypes import Union as Storage\nclass MemoryStatus(Storage):\n    _fields_ = []\n", "_fields_", "proven"),
    ("from builtins import classmethod as method\nclass Distance:\n    @method\n    def value(cls) -> int:\n        return 1\n", "cls", "proven"), ("class Medium:\n    def __init_subclass__(\n        # 子类接收者\n        cls,\n    ) -> None:\n        pass\n", "cls", "proven"), ("class Medium:\n    def __class_getitem__(cls, index):\n        pass\n", "cls", "proven"),
    ("class Distance:\n    @transform\n    def value(self) -> int:\n        return 1\n", "self", "proven"), ("from builtins import staticmethod as method\nclass Distance:\n    @method\n    def value(cls) -> int:\n        return 1\n", "cls", "identifier.unknown_token"), ("class Direction:\n    LEFT = 1\n", "LEFT", "identifier.canonical_form"),
    ("class Enum:\n    pass\nclass Direction(Enum):\n    LEFT = 1\n", "LEFT", "identifier.canonical_form"), ("from enum import Enum\nEnum = object\nclass Direction(Enum):\n    LEFT = 1\n", "LEFT", "identifier.canonical_form"), ("from enum import Enum\nif active:\n    Enum = object\nclass Direction(Enum):\n    LEFT = 1\n", "LEFT", "identifier.canonical_form"),
    ("from enum import Enum\nif active:\n    Enum = object\n    class Direction(Enum):\n        LEFT = 1\n", "LEFT", "identifier.canonical_form"), ("from another import Enum\nclass Direction(Enum):\n    LEFT = 1\n", "LEFT", "identifier.canonical_form"), (_ENUM + "left = 1\n", "left", "identifier.canonical_form"),
    ('from typing import TypeVar\nTypeVar = object\n_FieldValue = TypeVar("_FieldValue")\n', "_FieldValue", "identifier.canonical_form"), ('from typing import TypeVar\nfield_value = TypeVar("field_value")\n', "field_value", "identifier.canonical_form"), ("class MemoryStatus:\n    _fields_ = []\n", "_fields_", "identifier.canonical_form"),
    ("import ctypes\nctypes = other\nclass MemoryStatus(ctypes.Structure):\n    _fields_ = []\n", "_fields_", "identifier.canonical_form"), ("import ctypes\nctypes.Structure = other\nclass MemoryStatus(ctypes.Structure):\n    _fields_ = []\n", "_fields_", "identifier.canonical_form"),
    ("def __init_subclass__(cls) -> None:\n    pass\n", "cls", "identifier.unknown_token"), ("class Medium:\n    @staticmethod\n    def __init_subclass__(cls) -> None:\n        pass\n", "cls", "identifier.unknown_token"),
    (_ENUM + "left = descriptor()\n", "left", "unresolved"), (_ENUM + "_ignore_ = names\n    LEFT = 1\n", "_ignore_", "unresolved"), ("from enum import Enum\nfrom typing import TypeVar\nclass Direction(Enum):\n    FieldValue = TypeVar('FieldValue')\n", "FieldValue", "unresolved"),
    (_MEMBER + "@transform\n    @member\n    def LEFT():\n        return 1\n    RIGHT = 2\n", "LEFT", "unresolved"), (_MEMBER + "_ignore_ = names\n    @member\n    def LEFT():\n        return 1\n", "_ignore_", "unresolved"), ("from enum import Enum, member\nDECORATOR = member\nclass Direction(Enum):\n    @DECORATOR\n    def lower_name(cls):\n        return 1\n", "lower_name", "unresolved"),
    (_MEMBER + "DECORATOR = member\n    @DECORATOR\n    def lower_name(cls):\n        return 1\n", "lower_name", "unresolved"), ("from enum import Enum\nfrom other import DECORATOR\nclass Direction(Enum):\n    @DECORATOR\n    def lower_name(cls):\n        return 1\n", "lower_name", "unresolved"),
)))


def native_roles(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, outcome)``: native roles of Python names (B11): proven, unresolved where the family is blocked, or the rule that the subject breaks."""
    documents = spark.createDataFrame([(path, bytearray(source.encode())) for path, source, _, _ in ROLES], "relative_path string, content binary")
    wanted = spark.createDataFrame([(path, subject) for path, _, subject, _ in ROLES], "path string, subject string")
    table = review.checkpointed(review.facts(documents, AUTHORITY))
    broken = review.identifier_rules(table, AUTHORITY).filter("grade = 'hard_violation' or subject = 'cls'").join(wanted, ["path", "subject"]).groupBy("path").agg(F.min("rule").alias("rule"))
    cells = review.coverage(table, review._subjects(table, AUTHORITY), AUTHORITY).filter("family = 'identifier'").select("path", "state")
    outcome = F.when(F.col("state") == "blocked", "unresolved").otherwise(F.coalesce("rule", F.lit("proven")))
    return cells.join(broken, "path", "left").select("path", outcome.alias("outcome"))


_REJECTED = "observation method python@ast+direct-source-facts-v3 rejected source at 2:7: source is not valid UTF-8"
_UNSUPPORTED = "target and preprocessing analysis is unsupported at "
#: Sources and the blocked families with the reason that the contract states (the name of the observation method is this project's own).
REASONS = (
    ("src/velocity.py", b"# \xce\xb1\r\n    \xc3\xa9\xff", tuple((f, _REJECTED) for f in ("structure", "identifier", "documentation", "dependency_declaration"))),
    ("src/value.c", b"#include <stddef.h>\n#if ENABLED\n#include <stdint.h>\n#endif\n", (("dependency_declaration", _UNSUPPORTED + "1:1, 3:1"),)),
    ("src/value.cpp", b"import first;\n#include <vector>\n#if ENABLED\nimport second;\n#include <string>\n#endif\n", (("dependency_declaration", _UNSUPPORTED + "1:1, 2:1, 4:1, 5:1"),)),
    ("src/unowned.c", "/** 计算速度 */\n\n/** 计算距离 */\ndouble calculate_velocity(double value);\ndouble calculate_distance(double value);\n".encode(), (("documentation", "unresolved callable documentation facts: calculate_distance@5:8[tier]; calculate_velocity@4:8[tier]"),)),
    ("src/missing.py", b"def _load() -> None:\n    import sys, first_missing as missing, os\n    import second_missing, sys, os\n", (("dependency_declaration", "classification is absent from Authority at 2:17: first_missing; classification is absent from Authority at 3:12: second_missing"),)),
    ("src/clean.py", b"value = 1\n", ()),
)


def blocked_reasons(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, family, reason)``: blocked cells of the coverage with their reasons in order."""
    documents = spark.createDataFrame([(path, bytearray(content)) for path, content, _ in REASONS], "relative_path string, content binary")
    table = review.checkpointed(review.facts(documents, AUTHORITY))
    return review.coverage(table, review._subjects(table, AUTHORITY), AUTHORITY).filter("state = 'blocked'").select("path", "family", "reason")


QUERIES = {"contract_roles": native_roles, "contract_reasons": blocked_reasons, "contract_names": declared_names, "contract_findings": rule_findings, "contract_returns": return_shapes, "contract_prose": comment_prose, "contract_admission": admission_codes}
ORACLE = {
    "contract_roles": f"SELECT path, outcome FROM {_values((path, outcome) for path, _, _, outcome in ROLES)} AS v(path, outcome)",
    "contract_reasons": f"SELECT path, family, reason FROM {_values((path, family, reason) for path, _, cells in REASONS for family, reason in cells)} AS v(path, family, reason)",
    "contract_names": f"SELECT path, pos::BIGINT AS pos, name FROM {_values([(path, k, n) for path, _, names in NAMES for k, n in enumerate(names.split())])} AS v(path, pos, name)",
    "contract_findings": f"SELECT path, rule, line::BIGINT AS line FROM {_values(_expected())} AS v(path, rule, line)",
    "contract_returns": f"SELECT path, outcome FROM {_values((path, outcome) for path, _, outcome in RETURNS)} AS v(path, outcome)",
    "contract_prose": f"SELECT path, rule, line::BIGINT AS line FROM {_values((path, rule, line) for path, _, rule, line in PROSE if rule)} AS v(path, rule, line)",
    "contract_admission": f"SELECT pos::BIGINT AS pos, code FROM {_values((k, code) for k, (_, code) in enumerate(ADMISSION))} AS v(pos, code)",
}
