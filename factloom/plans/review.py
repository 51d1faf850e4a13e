"""The review: admitted files to facts, facts to findings and coverage, and one sealed, deterministic result.

Facts are computed once per file in an Arrow pass and written as a table to the shared checkpoint folder, because every rule reads them; project facts are
small admitted tables.  Rules are filters and joins over the facts, their union is the findings, coverage is the dense grid of file and family.
"""

from __future__ import annotations

import gc
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import naming, prose
from factloom.functions.contract import judge
from factloom.functions.lexing import language_of
from factloom.functions.observe import observe
from factloom.plans import catalog
from factloom.plans.shipping import checkpointed, ship_package, written
from factloom.sources.authority import Authority, Rejection, normalise_path

#: Identities of the observation methods, by language.
METHODS = {"python": "python@ast+direct-source-facts-v3", "rust": "rust@lexer+direct-source-facts-v3", "c": "c@lexer+direct-source-facts-v3", "cpp": "cpp@lexer+direct-source-facts-v3"}
SCHEMA_VERSION = 4
#: Repeated paths up to which they are sent to the facts instead of being joined by an exchange.
REPEATED_PATHS = 1_000_000
_FACTS = "path string, language string, fact string, line int, column_no int, subject string, role string, body string, detail string"
_FINDING = ["rule", "grade", "path", "line", "column_no", "subject", "observation", "question", "message"]


@dataclass
class Review:
    """A sealed result: three lazy tables and the one-row summary."""

    findings: DataFrame
    coverage: DataFrame
    summary: dict
    scope: dict

    @property
    def disposition(self) -> str:
        return self.summary["disposition"]


def facts(documents: DataFrame, authority: Authority, header_variants: bool = False) -> DataFrame:
    """Fact rows of ``documents(relative_path, content)``; unmanaged files give none.

    The header languages of the project facts, one admitted document on the driver, go to the workers; with ``header_variants`` a header is read as
    C and as C++ instead, for a caller that has the languages as a table and keeps the right rows afterwards.
    """
    import pyarrow as pa

    ship_package(documents.sparkSession)
    headers = documents.sparkSession.sparkContext.broadcast(dict(authority.header_languages))
    schema = T._parse_datatype_string(_FACTS)
    names = [f.name for f in schema]
    types = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string() for f in schema]

    def run(batches):
        # a file's tokens are freed by their counts: few searches for cycles are due
        gc.freeze()
        gc.set_threshold(50_000, 20, 100)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for path, content in zip(part.column("relative_path").to_pylist(), part.column("content").to_pylist()):
                    own = (path or "").replace("\\", "/")
                    if header_variants and own.endswith(".h"):
                        languages = ("c", "cpp")
                    else:
                        languages = () if own.endswith(".h") and own not in headers.value else (language_of(own, headers.value.get(own)),)
                    for language in filter(None, languages):
                        rows += [(own, language, *fact) for fact in observe(content, language)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return documents.select("relative_path", "content").mapInArrow(run, schema)


def _finding(frame: DataFrame, rule, observation, message, question=None, subject="subject") -> DataFrame:
    grade = dict((r, g) for r, g, _ in catalog.RULES)[rule] if isinstance(rule, str) else None
    return frame.select(
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"),
        (F.lit(grade) if grade else F.col("grade")).alias("grade"),
        "path", "line", "column_no", F.col(subject).alias("subject") if isinstance(subject, str) else subject.alias("subject"),
        observation.alias("observation"), (F.lit(question) if question else F.lit(None).cast("string")).alias("question"), F.lit(message).alias("message"),
    )


def _rejected() -> F.Column:
    """What a damage fact says of the source, as finding and as reason of the blocked families."""
    method = F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])[F.col("language")]
    return F.format_string("observation method %s rejected source at %d:%d: %s", method, F.col("line"), F.col("column_no"), F.col("body"))


def source_rules(table: DataFrame) -> DataFrame:
    """C1 to C4."""
    no_subject = F.lit("")
    damage, trailing, lines = table.filter("fact = 'damage'"), table.filter("fact = 'trailing'"), table.filter("fact = 'prose'")
    return (
        _finding(damage, "source.parseability", _rejected(), "source must be valid for its language", subject=no_subject)
        .unionByName(_finding(trailing, "source.trailing_comment", F.col("body"), "ordinary comments must not share a physical line with code", subject=no_subject))
        .unionByName(_finding(lines.filter(F.col("body").rlike(prose.STOP.pattern)), "source.comment_punctuation", F.col("body"), "comment prose must not end sentences with a full stop", subject=no_subject))
        .unionByName(_finding(lines.filter(F.col("body").rlike("[()（）]")), "source.comment_parentheses", F.col("body"), "comment prose has parentheses", "are the parentheses technically necessary?", subject=no_subject))
    )


def _names(table: DataFrame) -> DataFrame:
    """Judged names with their bare form, tokens and the checks that are string functions of one name."""

    @F.pandas_udf("struct<bare string, tokens array<string>, form_ok boolean, reserved boolean>")
    def parts(name, role, language):
        import pandas as pd

        rows = []
        for n, r, lang in zip(name, role, language):
            bare = naming.bare(n, r, lang)
            rows.append((bare, naming.name_tokens(bare), naming.form_ok(n, r, lang), naming.is_reserved(n, lang)))
        return pd.DataFrame(rows, columns=["bare", "tokens", "form_ok", "reserved"])

    names = table.filter("fact = 'name' and role <> 'receiver'").withColumn("owner", F.get_json_object("detail", "$.owner"))
    return names.withColumn("p", parts("subject", "role", "language")).select("path", "language", "line", "column_no", "subject", "role", "owner", "p.*")


def identifier_rules(table: DataFrame, authority: Authority, vocabulary: DataFrame | None = None) -> DataFrame:
    """C5 to C9 with at most one finding per declaration (C25): candidate, reserved, form, suffix, unknown.

    ``vocabulary(token)`` stands for the words of the project facts where they are a table of their own.
    """
    spark = table.sparkSession
    names = _names(table)
    single = F.exists("tokens", lambda t: F.length(t) == 1)
    greek = F.exists("tokens", lambda t: F.lower(t).isin(*catalog.GREEK))
    word = F.array_join(F.transform("tokens", lambda t: F.lower(t)), "_")
    role_free = F.regexp_replace(F.lower("bare"), rf"^({'|'.join(catalog.ROLE_PREFIXES)})_", "")
    snake = F.col("bare").rlike("^([a-z0-9_]+|[A-Z0-9_]+)$") & ~F.col("role").isin("tag", "type", "type_parameter")
    quantities: dict[str, list[str]] = {}
    for concept, suffix in authority.quantity_concepts:
        quantities.setdefault(concept, []).append(suffix)
    suffixes = sorted({s for _, s in authority.quantity_concepts})
    pairs = spark.createDataFrame([(f"{c}_{s}", True) for c, own in quantities.items() for s in own], "name string, registered boolean")
    wrong = spark.createDataFrame(
        [(c, "is registered without a suffix") for c in quantities] + [(f"{c}_{s}", "has the suffix of another concept") for c, own in quantities.items() for s in suffixes if s not in own],
        "name string, wrong string",
    ).dropDuplicates(["name"])
    vocabulary = spark.createDataFrame([(w,) for w in authority.token_vocabulary], "token string") if vocabulary is None else vocabulary
    marked = names.withColumn("id", F.struct("path", "line", "column_no", "subject")).withColumn("name", role_free).withColumn("words", word)
    marked = marked.join(pairs, "name", "left").join(wrong, "name", "left")
    wrong_suffix = snake & F.col("wrong").isNotNull() & F.col("registered").isNull()
    tokens = marked.filter(F.col("registered").isNull()).select("id", F.explode(F.transform("tokens", lambda t: F.lower(t))).alias("token"))
    prefixes = [*catalog.ROLE_PREFIXES]
    unknown = tokens.filter(~F.col("token").rlike("^[0-9]+$") & ~F.col("token").isin(*prefixes)).join(vocabulary, "token", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("unknown"))
    judged = marked.join(unknown, "id", "left")
    # registered spellings count for the very trait they are registered for
    registered = spark.createDataFrame(list(authority.external_fixed_identifiers), "language string, role string, owner string, subject string").distinct().withColumn("fixed", F.lit(True))
    judged = judged.join(registered, ["language", "role", "owner", "subject"], "left")
    confirmed = F.coalesce("fixed", F.lit(False))
    rule = (
        F.when((single | greek) & F.col("registered").isNull() & ~wrong_suffix, "identifier.candidate").when(F.col("reserved"), "identifier.reserved").when(~F.col("form_ok"), "identifier.canonical_form")
        .when(wrong_suffix, "identifier.representation_suffix").when(F.col("unknown").isNotNull() & ~confirmed, "identifier.unknown_token")
    )
    ruled = judged.withColumn("rule", rule).filter("rule is not null")
    review = F.col("rule").isin("identifier.candidate", "identifier.unknown_token")
    observation = F.when(F.col("rule") == "identifier.unknown_token", F.array_join("unknown", ", ")).when(F.col("rule") == "identifier.representation_suffix", F.col("wrong")).otherwise(F.col("role"))
    return ruled.withColumn("grade", F.when(review, "review_required").otherwise("hard_violation")).select(
        "rule", "grade", "path", "line", "column_no", "subject", observation.alias("observation"),
        F.when(review, "what is the complete concept name?").alias("question"), F.lit("names must follow the declared form and registered concepts").alias("message"),
    )


def _subjects(table: DataFrame, authority: Authority) -> DataFrame:
    """Documentation subjects with the tier that the public-callable facts decide."""
    spark = table.sparkSession
    detail = "struct<tier:string, params:array<string>, shape:string, doc:string, unsafe:boolean, template:array<string>, unread:boolean, effect:boolean, partial:boolean>"
    subjects = table.filter("fact = 'subject'").withColumn("d", F.from_json("detail", detail)).select("path", "language", "line", "column_no", "subject", "role", "d.*")
    public = spark.createDataFrame(list(authority.public_callables), "path string, subject string").withColumn("listed", F.lit(True))
    paths = spark.createDataFrame([(p,) for p in authority.listed_paths], "path string").withColumn("has_list", F.lit(True))
    owners = F.count(F.lit(1)).over(Window.partitionBy("path", "subject", "role"))
    joined = subjects.withColumn("owners", owners).join(public, ["path", "subject"], "left").join(paths, "path", "left")
    tier = F.when(F.col("tier") != "authority", F.col("tier")).when(F.col("listed") & (F.col("owners") > 1), "unknown").when(F.col("listed"), "public").when(F.col("has_list"), "internal").otherwise("unknown")
    return joined.withColumn("tier", tier)


def documentation_rules(subjects: DataFrame) -> DataFrame:
    """One Arrow pass of the contract over the subjects."""

    @F.pandas_udf("array<string>")
    def broken(language, role, tier, doc, params, shape, template, unsafe, effect):
        import pandas as pd

        out = []
        for lang, kind, t, text, p, s, tp, u, e in zip(language, role, tier, doc, params, shape, template, unsafe, effect):
            text = None if text is None or text != text else text
            out.append(judge(lang, kind, t, text, list(p) if p is not None else [], s, list(tp) if tp is not None else [], bool(e), bool(u)))
        return pd.Series(out)

    read = subjects.filter(~F.coalesce("unread", F.lit(False)))
    rows = read.withColumn("rule", F.explode(broken("language", "role", "tier", "doc", "params", "shape", "template", F.coalesce("unsafe", F.lit(False)), F.coalesce("effect", F.lit(False)))))
    grade = F.when(F.col("rule") == "documentation.parentheses", "review_required").otherwise("hard_violation")
    return rows.select(
        "rule", grade.alias("grade"), "path", "line", "column_no", "subject", F.col("role").alias("observation"),
        F.when(F.col("rule") == "documentation.parentheses", "are the parentheses technically necessary?").alias("question"), F.lit("documentation must follow the contract of its declaration").alias("message"),
    )


def _imports(table: DataFrame, authority: Authority) -> DataFrame:
    spark = table.sparkSession
    detail = "struct<group:bigint, statement:bigint, item:bigint, start:int, end:int>"
    classes = spark.createDataFrame(list(authority.dependency_classes), "body string, class string")
    rows = table.filter("fact = 'import'").withColumn("d", F.from_json("detail", detail)).select("path", "language", "line", "column_no", "subject", "role", "body", "d.*")
    joined = rows.join(classes, "body", "left")
    rank = F.when(F.col("role") == "relative", 2).when(F.col("class") == "standard", 0).when(F.col("class") == "third_party", 1).when(F.col("class") == "project", 2)
    return joined.withColumn("class_rank", F.when(F.col("language") == "python", rank))


def dependency_rules(table: DataFrame, authority: Authority) -> DataFrame:
    """Wildcards, adjacent order with blank lines (W1 to W4) where reordering is safe, module placement."""
    none = F.lit(None).cast("string")
    out = _finding(table.filter("fact = 'wildcard'"), "dependency.wildcard", F.col("subject"), "wildcard imports are not allowed")
    out = out.unionByName(_finding(table.filter("fact = 'misplaced'"), "dependency.module_placement", F.col("subject"), "module imports must precede declarations"))
    if authority.rust_reorder_safe:
        out = out.unionByName(_finding(table.filter("fact = 'misorder'"), "dependency.order", F.col("subject"), "neighbouring imports are out of order"))
    if authority.python_reorder_safe:
        order = Window.partitionBy("path", "group").orderBy("statement", "item")
        known = F.when(F.col("class_rank").isNotNull(), F.struct("class_rank", F.col("subject").alias("module")))
        rows = _imports(table, authority).filter("language = 'python' and role <> 'future'").withColumn("key", known)
        neighbours = rows.withColumn("before", F.lag("key").over(order)).withColumn("before_end", F.lag("end").over(order)).withColumn("before_statement", F.lag("statement").over(order))
        gap = F.col("start") - F.col("before_end") - 1
        blank = F.when(F.col("before.class_rank") == F.col("key.class_rank"), gap != 0).otherwise(gap != 1)
        bad = (F.col("before") > F.col("key")) | ((F.col("statement") != F.col("before_statement")) & F.col("before").isNotNull() & F.col("key").isNotNull() & blank)
        out = out.unionByName(_finding(neighbours.filter(bad), "dependency.order", F.col("subject"), "neighbouring imports are out of order"))
    return out.withColumn("question", none)


def coverage(table: DataFrame, subjects: DataFrame, authority: Authority) -> DataFrame:
    """The dense grid (A.6, G5): six cells per file, each complete with a count or blocked with its reasons in order."""
    spark = table.sparkSession
    files = table.filter("fact = 'lines'").select("path", "language", F.col("line").alias("physical"))
    damage = table.filter("fact = 'damage'").select("path", _rejected().alias("damage"))

    def joined(rows, family, sort):
        return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*sort, "gap"))), lambda x: x["gap"]), "; ").alias("gap")).withColumn("family", F.lit(family))

    at = F.concat_ws(":", "line", "column_no")
    tier_gap, return_gap = F.col("tier") == "unknown", (F.col("shape") == "Unknown") & F.col("tier").isin("public", "unknown")
    name_gap = F.coalesce("partial", F.lit(False)) & F.col("tier").isin("public", "unknown")
    unread, called = F.coalesce("unread", F.lit(False)), F.col("role") == "callable"
    gaps = subjects.filter(called & (tier_gap | return_gap | name_gap) | unread).withColumn(
        "gap", F.concat(F.col("subject"), F.lit("@"), at, F.when(called & tier_gap, "[tier]").otherwise(""), F.when(called & return_gap, "[return]").otherwise(""), F.when(called & name_gap, "[parameters]").otherwise(""), F.when(unread, "[text]").otherwise(""))
    )
    documentation = joined(gaps, "documentation", ["subject", "line"]).withColumn("gap", F.concat(F.lit("unresolved callable documentation facts: "), F.col("gap")))
    imports = _imports(table, authority)
    unclassified = imports.filter("(language = 'python' and class_rank is null and role <> 'future')").withColumn("gap", F.concat(F.lit("classification is absent from Authority at "), at, F.lit(": "), F.col("subject")))
    mixed = imports.filter("language = 'python'").groupBy("path", "statement").agg(F.countDistinct("class_rank").alias("n"), F.min("line").alias("line"), F.min("column_no").alias("column_no")).filter("n > 1").withColumn("gap", F.lit("mixed-class import statement layout is unsupported"))
    # one reason for all of a file's native imports, their places in source order
    places = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "column_no"))), lambda x: F.concat_ws(":", x["line"], x["column_no"])), ", ")
    native = imports.filter("role = 'include'").groupBy("path").agg(places.alias("places"), F.min("line").alias("line"), F.min("column_no").alias("column_no"))
    includes = native.withColumn("gap", F.concat(F.lit("target and preprocessing analysis is unsupported at "), F.col("places")))
    columns = ["path", "line", "column_no", "gap"]
    unknown = table.filter("fact = 'gap' and role = 'dependency_declaration'").withColumn("gap", F.concat(F.col("body"), F.lit(" at "), at, F.lit(": "), F.col("subject")))
    dependency = joined(unclassified.select(columns).unionByName(mixed.select(columns)).unionByName(includes.select(columns)).unionByName(unknown.select(columns)), "dependency_declaration", ["line", "column_no"])
    identifier = joined(table.filter("fact = 'gap' and role = 'identifier'").withColumn("gap", F.concat(F.col("body"), F.lit(" at "), at)), "identifier", ["line", "column_no"])
    gap_cells = documentation.unionByName(dependency).unionByName(identifier)
    counts = (
        table.filter("fact in ('name', 'subject')").groupBy("path", F.when(F.col("fact") == "name", "identifier").otherwise("documentation").alias("family")).agg(F.count(F.lit(1)).alias("n"))
        .unionByName(imports.groupBy("path", F.lit("dependency_declaration").alias("family")).agg(F.countDistinct("group", "statement").alias("n")))
    )
    grid = files.crossJoin(F.broadcast(catalog.families(spark)))  # times six literal rows
    cells = grid.join(damage, "path", "left").join(gap_cells, ["path", "family"], "left").join(counts, ["path", "family"], "left")
    reason = F.when(F.col("family_ordinal") >= 2, F.coalesce("damage", "gap"))
    count = F.when(F.col("family_ordinal") == 1, F.col("physical")).when(F.col("family_ordinal") < 3, 1).otherwise(F.coalesce("n", F.lit(0)))
    return cells.select(
        "path", "family", "family_ordinal", F.when(reason.isNull(), "complete").otherwise("blocked").alias("state"), F.when(reason.isNull(), count).cast("int").alias("count"), reason.alias("reason")
    )


def presented(findings: DataFrame) -> DataFrame:
    """Findings in presentation order, every tie settled."""
    ranked = findings.join(F.broadcast(catalog.rules(findings.sparkSession).select("rule", "chapter", "rule_rank", "grade_rank")), "rule")
    return ranked.orderBy("grade_rank", "rule_rank", "path", "line", "column_no", "subject", "observation")


def _seal(frame: DataFrame, keys: list[str]) -> str:
    """Order-insensitive digest: the count of rows and the sums of the eight words of their SHA-256; one row of numbers reaches the driver.

    Sums of hashes commute, so rows are combined where they are and no group of them is ever gathered; equal rows count as often as they occur.
    """
    row = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(k) for k in keys])), 256)
    words = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
    sums = frame.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(f"w{k}") for k, w in enumerate(words)]).first()
    return hashlib.sha256(repr([str(x or 0) for x in sums]).encode()).hexdigest()


def admit_documents(documents: DataFrame, authority: Authority, revision: str | None) -> None:
    """Reject an empty revision, paths that are not normal or collide, and (in a document set) unmanaged files."""
    if revision is not None and not revision.strip():
        raise Rejection("scope.revision", "revision must not be empty")
    paths = documents.select(F.translate("relative_path", "\\", "/").alias("p"))
    doubled = paths.groupBy("p").count().filter("count > 1").limit(1).collect()
    bad = paths.filter(F.col("p").isNull() | F.col("p").rlike(r"^$|^/|^[A-Za-z]:|(^|/)(\.{0,2})(/|$)")).limit(1).collect()
    if doubled or bad:
        raise Rejection("scope.path", f"path is not normal or occurs twice: {(doubled or bad)[0][0]}")
    if revision is not None:
        listed = documents.sparkSession.createDataFrame([(p,) for p, _ in authority.header_languages], "p string")
        stray = paths.filter(~F.col("p").rlike(r"\.(py|rs|c|cc|cpp|cxx|hpp|hh|hxx)$")).join(listed, "p", "left_anti").limit(1).collect()
        if stray:
            raise Rejection("scope.language", f"file has no managed language: {stray[0][0]}")


def review(documents: DataFrame, authority: Authority, revision: str | None = None, root: str | None = None) -> Review:
    """Review ``documents(relative_path, content)``: a document set with a revision, or a workspace with a root."""
    admit_documents(documents, authority, revision)
    table = written(facts(documents, authority))
    subjects = _subjects(table, authority)
    findings = checkpointed(
        source_rules(table).unionByName(identifier_rules(table, authority)).unionByName(documentation_rules(subjects)).unionByName(dependency_rules(table, authority)).select(*_FINDING).distinct()
    )
    cells = checkpointed(coverage(table, subjects, authority))
    counted = findings.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("grade") == "hard_violation").alias("hard"), F.count_if(F.col("grade") == "review_required").alias("review")).first()
    blocked = cells.filter("state = 'blocked'").count()
    metrics = table.filter("fact = 'lines'").count()
    encoding = table.filter("fact = 'damage' and role = 'encoding'").count()
    completion = "incomplete" if blocked else "complete"
    disposition = "incomplete" if blocked else "findings" if counted.total else "clean"
    scope = {"kind": "documents", "value": {"revision": revision, "files": metrics}} if revision is not None else {"kind": "workspace", "value": {"root": root, "files": metrics}}
    snapshot = _seal(documents.withColumn("digest", F.sha2("content", 256)), ["relative_path", "digest"])
    parts = [SCHEMA_VERSION, scope, completion, _seal(findings, _FINDING), _seal(cells, ["path", "family", "state", "count", "reason"]), snapshot]
    seal = hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()
    summary = {
        "completion": completion, "disposition": disposition, "finding_summary": {"total": counted.total, "hard_violation": counted.hard, "review_required": counted.review}, "blocked_families": blocked,
        "metrics": {"files_read": metrics, "byte_sweeps": metrics, "structural_parses": metrics - encoding}, "semantic_authority_digest": hashlib.sha256(authority.canonical().encode()).hexdigest(), "snapshot_digest": snapshot, "seal": seal,
    }
    return Review(findings, cells, summary, scope)


def review_workspace(spark: SparkSession, root: str, authority: Authority) -> Review:
    """Review the managed files below a directory."""
    from factloom.sources.workspace import WorkspaceSource, check_paths

    check_paths(root)
    ship_package(spark)
    spark.dataSource.register(WorkspaceSource)
    documents = spark.read.format("workspace").load(root)
    listed = spark.createDataFrame([(p,) for p, _ in authority.header_languages], "relative_path string")
    strays = documents.select("relative_path").filter(F.col("relative_path").endswith(".h")).join(listed, "relative_path", "left_anti")
    return review(documents.join(strays, "relative_path", "left_anti"), authority, root=root)


def to_json(result: Review) -> str:
    """The machine projection; findings and blocked cells in presentation order."""
    findings = [{k: row[k] for k in _FINDING} for row in presented(result.findings).toLocalIterator()]
    for f in findings:
        f["column"] = f.pop("column_no")
    blocked = [{"file": r.path, "family": r.family, "reason": r.reason} for r in result.coverage.filter("state = 'blocked'").orderBy("path", "family_ordinal").toLocalIterator()]
    chapters: dict[str, list[str]] = {}
    for rule, _, chapter in catalog.RULES:
        chapters.setdefault(chapter, []).append(rule)
    body = {"scope": result.scope, "completion": result.summary["completion"], "finding_summary": result.summary["finding_summary"], "blocked_families": result.summary["blocked_families"], "findings": findings, "blocked_family_details": blocked, "metrics": result.summary["metrics"], "presentation": chapters, "seal": result.summary["seal"]}
    return json.dumps({"schema_version": SCHEMA_VERSION, "terminal": "sealed", "disposition": result.disposition, "review": body}, ensure_ascii=False)


def write_json(result: Review, folder: str) -> None:
    """The machine projection of a result of any size: findings and blocked cells as sorted JSON lines written by the executors, the head beside them."""
    ranked = presented(result.findings).select(*_FINDING[:4], F.col("column_no").alias("column"), *_FINDING[5:], "grade_rank", "rule_rank")
    keys = ["grade_rank", "rule_rank", "path", "line", "column", "subject", "observation"]
    ranked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("grade_rank", "rule_rank").write.mode("overwrite").json(f"{folder}/findings")
    cells = result.coverage.filter("state = 'blocked'").select(F.col("path").alias("file"), "family", "reason", "family_ordinal")
    cells.repartitionByRange("file", "family_ordinal").sortWithinPartitions("file", "family_ordinal").drop("family_ordinal").write.mode("overwrite").json(f"{folder}/blocked_family_details")
    head = {"schema_version": SCHEMA_VERSION, "terminal": "sealed", "disposition": result.disposition, "scope": result.scope, **result.summary}
    spark = result.findings.sparkSession
    spark.createDataFrame([(json.dumps(head, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/review")


def canonical(result: Review) -> bytes:
    """The sealed bytes without presentation, fields in their fixed order."""
    full = json.loads(to_json(result))["review"]
    cells = [r.asDict() for r in result.coverage.orderBy("path", "family_ordinal").toLocalIterator()]
    ordered = {"schema_version": SCHEMA_VERSION, "scope": full["scope"], "completion": full["completion"], "coverage": cells, "findings": full["findings"], "metrics": full["metrics"], "semantic_authority_digest": result.summary["semantic_authority_digest"], "snapshot_digest": result.summary["snapshot_digest"], "seal": full["seal"]}
    return json.dumps(ordered, ensure_ascii=False).encode()


def error_json(rejection: Rejection) -> str:
    """The machine projection of a rejected review."""
    return json.dumps({"schema_version": SCHEMA_VERSION, "terminal": "rejected", "disposition": "rejected", "error": {"code": rejection.code, "message": rejection.message}}, ensure_ascii=False)


def scope_label(scope: dict) -> str:
    value = scope["value"]
    return f"{scope['kind']}:{value.get('revision') or value.get('root')} ({value['files']} files)"


def to_text(result: Review) -> str:
    """The human projection: header lines, findings by chapter, blocked families; dynamic fields escaped."""
    s, e = result.summary, prose.escape_debug
    out = [f"scope: {e(scope_label(result.scope))}", f"disposition: {result.disposition}", f"completion: {s['completion']}", "findings: {total} (hard {hard_violation}, review {review_required})".format(**s["finding_summary"]), f"blocked families: {s['blocked_families']}", f"files read: {s['metrics']['files_read']}", f"seal: {s['seal']}", "", "findings:"]
    chapter = None
    for row in presented(result.findings).toLocalIterator():
        if row.chapter != chapter:
            chapter = row.chapter
            out.append(f"  [{chapter}]")
        out.append(f"  {row.rule} {''.join(w.title() for w in row.grade.split('_'))} {e(row.path)}:{row.line}:{row.column_no} {e(row.subject or '')} {e(row.observation or '')}")
        if row.question:
            out.append(f"    {row.question}")
    if chapter is None:
        out.append("  none")
    out.append("blocked:")
    rows = [f"  {e(r.path)} {''.join(w.title() for w in r.family.split('_'))}: {e(r.reason)}" for r in result.coverage.filter("state = 'blocked'").orderBy("path", "family_ordinal").toLocalIterator()]
    return "\n".join(out + (rows or ["  none"]))


def stored_facts(spark: SparkSession, directory: str) -> tuple[DataFrame, Authority, DataFrame]:
    """Checkpointed facts of the stored files, each once, project facts that suit them, and the words of the part names as vocabulary.

    Contents are read once and never shuffled: a header's facts are computed for both languages, and the header facts then decide by path.
    """
    from factloom.sources.tables import header_profiles
    from factloom.sources.tables import table as stored

    words = stored(spark, directory, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z]+")).alias("token")).filter("token <> ''").distinct()
    authority = Authority(dependency_classes=(("itertools", "standard"), ("json", "standard"), ("math", "standard"), ("os", "standard"), ("sys", "standard")), python_reorder_safe=True, rust_reorder_safe=True)
    files = stored(spark, directory, "source_documents").filter("file_id is not null and relative_path is not null").select("relative_path", "content")
    read = written(facts(files, authority, header_variants=True))
    # only the facts of files that were delivered more than once have to be compared with each other
    repeated = checkpointed(files.groupBy(F.translate("relative_path", "\\", "/").alias("path")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path"))
    count = repeated.count()
    if count:
        side = F.broadcast(repeated) if count <= REPEATED_PATHS else repeated
        several = read.join(side, "path", "left_semi").dropDuplicates(["path", "language", "fact", "line", "column_no", "subject", "role", "body"])
        read = read.join(side, "path", "left_anti").unionByName(several)
    profiles = header_profiles(spark, directory).withColumnRenamed("profile", "_profile")
    headers = read.filter(F.col("path").endswith(".h")).join(profiles, "path", "left")
    kept = headers.filter(F.col("language") == F.when(F.col("_profile") == "cpp", "cpp").otherwise("c")).drop("_profile")
    return read.filter(~F.col("path").endswith(".h")).unionByName(kept), authority, words


def stored_findings(spark: SparkSession, directory: str) -> DataFrame:
    """Findings of all rules over the stored files."""
    table, authority, words = stored_facts(spark, directory)
    subjects = _subjects(table, authority)
    found = source_rules(table).unionByName(identifier_rules(table, authority, words)).unionByName(documentation_rules(subjects)).unionByName(dependency_rules(table, authority))
    return found.select(*_FINDING).distinct()


def stored_coverage(spark: SparkSession, directory: str) -> DataFrame:
    """Coverage cells of the stored files."""
    table, authority, _ = stored_facts(spark, directory)
    return coverage(table, _subjects(table, authority), authority)


def stored_observations(spark: SparkSession, directory: str) -> DataFrame:
    """Observed facts per language, kind and role."""
    table, _, _ = stored_facts(spark, directory)
    return table.groupBy("language", "fact", F.when(F.col("fact").isin("name", "subject", "import", "damage"), F.col("role")).alias("role")).agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("path").alias("files"))


__all__ = ["Review", "normalise_path", "review", "review_workspace", "to_json", "to_text", "canonical", "error_json"]
