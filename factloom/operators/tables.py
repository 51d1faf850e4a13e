"""Relational operators of a review over stored tables: admission, coverage, summaries, ordering, naming and prose rules.

Every function takes ``(spark, directory)`` and returns a lazy DataFrame; nulls are kept or excluded as each docstring says, empty tables give
empty results (summaries one row of zeros), and only columns that are named are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.plans import catalog
from factloom.plans.shipping import checkpointed
from factloom.sources.tables import header_profiles, normalised_path, table


def _language(path: str = "path", profile: str = "profile") -> F.Column:
    extension = F.when(F.substring_index(path, "/", -1).contains("."), F.substring_index(path, ".", -1))
    return (
        F.when(extension == "py", "python").when(extension == "rs", "rust").when(extension == "c", "c").when(extension.isin("cc", "cpp", "cxx", "hpp", "hh", "hxx"), "cpp")
        .when(extension == "h", F.when(F.col(profile) == "cpp", "cpp").otherwise("c"))
    )


def _documents(spark: SparkSession, directory: str, *columns) -> DataFrame:
    """Files once each, by their identity; the columns must be functions of the content so that it is never shuffled."""
    rows = table(spark, directory, "source_documents").filter("file_id is not null")
    return rows.select("file_id", normalised_path("relative_path").alias("path"), *columns).dropDuplicates(["file_id"])


def language_admission(spark, directory):
    """Language of each file (A12, A13, J1): header facts joined on the exact path, unmanaged files have null."""
    headers = header_profiles(spark, directory)
    files = _documents(spark, directory)
    return files.join(headers, "path", "left").select("file_id", "path", _language().alias("language"))


def capture_inventory(spark, directory):
    """Size, validity, physical lines and SHA-256 of each captured file (A15, B1, B2, F15); lines and text length are null for invalid UTF-8."""
    valid = F.expr("is_valid_utf8(cast(content as string))")
    text = F.when(valid, F.col("content").cast("string"))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return _documents(
        spark, directory, F.length("content").cast("bigint").alias("n_bytes"), valid.alias("valid"), lines.cast("bigint").alias("lines"), F.sha2("content", 256).alias("digest")
    ).drop("path")


def duplicate_contents(spark, directory):
    """Contents that several files have."""
    once = _documents(spark, directory, F.sha2("content", 256).alias("digest"))
    return once.groupBy("digest").agg(F.count(F.lit(1)).alias("files"), F.min("file_id").alias("first_file")).filter("files > 1")


def duplicate_paths(spark, directory):
    """Paths of findings written in more than one way."""
    findings = table(spark, directory, "findings").filter("path is not null")
    return findings.groupBy(normalised_path("path").alias("path")).agg(F.countDistinct("path").alias("spellings")).filter("spellings > 1")


def profile_totals(spark, directory):
    """Files, lines and bytes of each language (G10, G11); invalid files count no lines."""
    captured = capture_inventory(spark, directory).join(language_admission(spark, directory).select("file_id", "language"), "file_id")
    return captured.filter("language is not null").groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"), F.sum("n_bytes").alias("n_bytes"), F.count_if(~F.col("valid")).alias("invalid")
    )


def admission_by_profile(spark, directory):
    """Candidates minus files blocked in structure, per language, with the admitted ratio (G10, U2: a left-anti join)."""
    files = language_admission(spark, directory).filter("language is not null")
    damaged = table(spark, directory, "blocked").filter("family = 'structure'").select(normalised_path("file").alias("path")).distinct()
    admitted = files.join(damaged, "path", "left_anti").groupBy("language").agg(F.count(F.lit(1)).alias("admitted"))
    return (
        files.groupBy("language").agg(F.count(F.lit(1)).alias("candidates")).join(admitted, "language", "left")
        .select("language", "candidates", F.coalesce("admitted", F.lit(0)).alias("admitted"), F.round(F.coalesce("admitted", F.lit(0)) / F.col("candidates"), 6).alias("ratio"))
    )


def _findings(spark, directory) -> DataFrame:
    """Findings once per id; nulls in the id are dropped, paths normalised."""
    columns = ("finding_id", "revision", "rule", "grade", "line_no", "column_no", "subject")
    rows = table(spark, directory, "findings").filter("finding_id is not null")
    return rows.select(*columns, normalised_path("path").alias("path")).dropDuplicates(["finding_id"])


def finding_summary(spark, directory):
    """Totals by grade (G1), one row."""
    return _findings(spark, directory).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("grade") == "hard_violation").alias("hard_violation"), F.count_if(F.col("grade") == "review_required").alias("review_required")
    )


def rule_grade_counts(spark, directory):
    """Findings per grade and rule."""
    return _findings(spark, directory).groupBy("grade", "rule").agg(F.count(F.lit(1)).alias("findings"))


def presentation_order(spark, directory):
    """Findings in presentation order (J8, O1, O2): grade, rule rank, path, position; ties by subject and id. Rules not in the catalogue come last."""
    joined = _findings(spark, directory).select("finding_id", "rule", "grade", "path", "line_no", "column_no", "subject").join(F.broadcast(catalog.rules(spark).select("rule", "chapter", "rule_rank")), "rule", "left")
    rank = F.when(F.col("grade") == "hard_violation", 0).when(F.col("grade") == "review_required", 1).otherwise(2)
    keys = ["grade_rank", F.asc_nulls_last("rule_rank"), F.asc_nulls_first("path"), F.asc_nulls_first("line_no"), F.asc_nulls_first("column_no"), F.asc_nulls_first("subject"), "finding_id"]
    return joined.withColumn("grade_rank", rank).orderBy(*keys).select("finding_id", "grade_rank", "chapter", "rule_rank", "path", "line_no", "column_no", "subject")


def chapter_counts(spark, directory):
    """Findings per chapter."""
    return _findings(spark, directory).join(F.broadcast(catalog.rules(spark).select("rule", "chapter")), "rule").groupBy("chapter").agg(F.count(F.lit(1)).alias("findings"))


def _cells(spark, directory) -> DataFrame:
    """Coverage cells once per (revision, path, family)."""
    return table(spark, directory, "coverage").select("revision", normalised_path("path").alias("path"), "family", "state", "fact_count", "reason").dropDuplicates(["revision", "path", "family"])


def coverage_cells(spark, directory):
    """The dense grid of files and families (G5, A.6): every reviewed file has six cells; a missing one counts as blocked without a reason."""
    cells = _cells(spark, directory)
    files = cells.select("revision", "path").distinct().crossJoin(F.broadcast(catalog.families(spark)))  # times six literal rows
    return files.join(cells, ["revision", "path", "family"], "left").select(
        "revision", "path", "family", "family_ordinal", F.coalesce("state", F.lit("blocked")).alias("state"), F.col("fact_count").cast("bigint").alias("fact_count")
    )


def family_totals(spark, directory):
    """Cells, blocked cells and facts of each family."""
    return _cells(spark, directory).groupBy("family").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("state") == "blocked").alias("blocked"), F.sum(F.coalesce("fact_count", F.lit(0))).cast("bigint").alias("facts")
    )


def file_completion(spark, directory):
    """Whether each file's coverage is complete (G3), with its blocked families."""
    return _cells(spark, directory).groupBy("revision", "path").agg(
        F.count_if(F.col("state") == "blocked").alias("blocked_families"), F.when(F.bool_or(F.col("state") == "blocked"), "incomplete").otherwise("complete").alias("completion")
    )


def disposition(spark, directory):
    """Completion and disposition of each revision (G1, G3, G4): incomplete before findings before clean."""
    cells = _cells(spark, directory).groupBy("revision").agg(F.bool_or(F.col("state") == "blocked").alias("any_blocked"))
    found = _findings(spark, directory).groupBy("revision").agg(F.count(F.lit(1)).alias("findings"))
    return cells.join(found, "revision", "left").select(
        "revision",
        F.when(F.col("any_blocked"), "incomplete").otherwise("complete").alias("completion"),
        F.when(F.col("any_blocked"), "incomplete").when(F.coalesce("findings", F.lit(0)) > 0, "findings").otherwise("clean").alias("disposition"),
    )


def blocked_details(spark, directory):
    """Blocked families of each file with their reasons joined in order (G7, O3): deliveries once, ``; `` between reasons."""
    rows = table(spark, directory, "blocked").select("revision", normalised_path("file").alias("file"), "family", "reason").distinct()
    reasons = F.array_join(F.array_sort(F.collect_list("reason")), "; ")
    return (
        rows.groupBy("revision", "file", "family").agg(reasons.alias("reason"), F.count("reason").alias("reasons"))
        .join(F.broadcast(catalog.families(spark)), "family").orderBy("file", "family_ordinal", "revision").select("revision", "file", "family", "family_ordinal", "reason", "reasons")
    )


def blocked_against_coverage(spark, directory):
    """Blocked coverage cells that no blocked detail reports (U2): a left-anti join on revision, path and family."""
    reported = table(spark, directory, "blocked").select("revision", normalised_path("file").alias("path"), "family").distinct()
    return _cells(spark, directory).filter("state = 'blocked'").join(reported, ["revision", "path", "family"], "left_anti").select("revision", "path", "family")


def unresolved_positions(spark, directory):
    """Line and column that each reason of a rejected source points at (B1, 7.6)."""
    at = r"at (\d+):(\d+)"
    rows = table(spark, directory, "blocked").select(normalised_path("file").alias("file"), "reason").distinct().filter(F.col("reason").rlike(at))
    return rows.select("file", F.regexp_extract("reason", at, 1).cast("bigint").alias("line"), F.regexp_extract("reason", at, 2).cast("bigint").alias("column_no"), "reason")


def nearest_rank_p95(spark, directory):
    """Nearest-rank 95th percentile and maximum of a measure per kind."""
    events = table(spark, directory, "events").filter("value is not null").select("event_type", "value")
    # a kind may hold most rows: values are counted where they are, ranged on (kind, value), and each range adds its own counts to those before it
    counted = events.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("event_type", "value").withColumn("part", F.spark_partition_id())
    counted = checkpointed(counted)
    totals = counted.groupBy("event_type").agg(F.sum("n").alias("runs"), F.max("value").alias("most"))
    ranges = counted.groupBy("event_type", "part").agg(F.sum("n").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("event_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumn("before", before).alias("r").join(totals.alias("t"), F.col("r.event_type").eqNullSafe(F.col("t.event_type"))).select("r.event_type", "part", "held", "before", "runs", "most")
    # the one range of each kind that holds the wanted rank
    rank = F.expr("(runs * 95 + 99) div 100")
    holding = placed.withColumn("rank", rank).filter("before < rank and rank <= before + held")
    inside = counted.alias("c").join(holding.alias("h"), F.col("c.event_type").eqNullSafe(F.col("h.event_type")) & (F.col("c.part") == F.col("h.part"))).select("h.event_type", "value", "n", "before", "rank", "runs", "most")
    upto = F.sum("n").over(Window.partitionBy("event_type").orderBy("value"))
    reached = inside.withColumn("upto", upto + F.col("before")).filter("upto >= rank")
    return reached.groupBy("event_type").agg(F.min("value").alias("p95"), F.max("most").alias("most"), F.max("runs").alias("runs"))


def distinct_digests(spark, directory):
    """Deliveries and distinct contents of each file (G14): determinism means exactly one."""
    rows = table(spark, directory, "source_documents").filter("file_id is not null")
    return rows.select("file_id", F.sha2("content", 256).alias("digest")).groupBy("file_id").agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct("digest").alias("digests"))


def _lines(spark, directory) -> DataFrame:
    documents = table(spark, directory, "documents").filter("text is not null").select("doc_id", F.regexp_replace("text", "\r\n", "\n").alias("text"))
    return documents.select("doc_id", F.posexplode(F.split("text", "\n"))).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line"), F.col("col").alias("body"))


def prose_findings(spark, directory):
    """Sentence stops and parentheses in prose lines (C3, C4, F8, U1): a finding per rule and line."""
    rules = F.array(
        F.when(F.col("body").rlike(r"。|[A-Za-z)][.](\s|$)"), F.struct(F.lit("source.comment_punctuation").alias("rule"), F.lit("hard_violation").alias("grade"))),
        F.when(F.col("body").rlike("[()（）]"), F.struct(F.lit("source.comment_parentheses").alias("rule"), F.lit("review_required").alias("grade"))),
    )
    return _lines(spark, directory).select("doc_id", "line", F.inline(F.array_compact(rules))).select("doc_id", "line", "rule", "grade")


def physical_lines(spark, directory):
    """Physical lines of each document (B2)."""
    text = F.col("text")
    count = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return table(spark, directory, "documents").select("doc_id", count.cast("bigint").alias("lines"))


def cjk_summaries(spark, directory):
    """Whether the first line of a document has two consecutive ideographs."""
    first = F.split("text", "\n").getItem(0)
    return table(spark, directory, "documents").filter("text is not null").select("doc_id", first.rlike("[一-鿿]{2}").alias("has_summary"))


def _subject_tokens(spark, directory) -> DataFrame:
    names = table(spark, directory, "findings").filter("subject is not null").select("subject").distinct()
    bare = F.regexp_replace(F.regexp_replace("subject", "^_+|^r#|^'|_t$|_$", ""), "([a-z])([A-Z])", "$1_$2")
    return names.select("subject", F.posexplode(F.split(bare, "_"))).filter("col <> ''").select("subject", "pos", F.col("col").alias("token"))


def identifier_tokens(spark, directory):
    """Tokens of each judged name (F1), parted by underscores and changes of case, with the candidate test (C5, F3, J4): a single raw character or a transliterated Greek letter."""
    greek = F.lower("token").isin(*catalog.GREEK)
    return _subject_tokens(spark, directory).select("subject", F.col("pos").cast("bigint").alias("pos"), "token", ((F.length("token") == 1) | greek).alias("is_candidate"))


def unknown_tokens(spark, directory):
    """Tokens outside the vocabulary (C6, J3), the vocabulary being the words of the part names: a left-anti join on the lower-case token."""
    words = table(spark, directory, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z]+")).alias("token")).distinct()
    tokens = _subject_tokens(spark, directory).select(F.lower("token").alias("token"))
    return tokens.filter((F.length("token") > 1) & ~F.col("token").isin(*catalog.GREEK)).join(words, "token", "left_anti").groupBy("token").agg(F.count(F.lit(1)).alias("uses"))


def name_forms(spark, directory):
    """Case form and role prefix of each judged name."""
    name = F.col("subject")
    form = (
        F.when(name.rlike("^_?[a-z][a-z0-9]*(_[a-z0-9]+)*$"), "lower_snake").when(name.rlike("^_?[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"), "upper_snake")
        .when(name.rlike("^_?[A-Z][A-Za-z0-9]*$"), "pascal").otherwise("other")
    )
    allowed, forbidden = "|".join(catalog.ROLE_PREFIXES), "|".join(catalog.FORBIDDEN_PREFIXES)
    bad = F.lower(name).rlike(rf"^_?(({forbidden})_|({allowed})_({allowed}|{forbidden})_)")
    return table(spark, directory, "findings").filter("subject is not null").select("subject").distinct().select(
        "subject", form.alias("form"), F.lower(name).rlike(rf"^_?({allowed})_").alias("has_role"), bad.alias("bad_prefix")
    )


#: Registered suffixes of the quantity query, a stand-in for project facts.
QUANTITIES = {"distance": ("m", "mm"), "duration": ("s",), "velocity": ("m_per_s",), "phase": ("rad", "deg"), "profile": ("mm",), "valve": ("s",)}


def quantity_suffixes(spark, directory):
    """Registered concepts used bare or with a foreign suffix (C9, F6, J5): equi-joins on the concept and on (concept, suffix)."""
    pairs = spark.createDataFrame([(c, s) for c, own in QUANTITIES.items() for s in own], "concept string, suffix string")
    names = table(spark, directory, "findings").filter("subject is not null").select("subject").distinct().select("subject", F.lower("subject").alias("name"))
    parts = F.split("name", "_")
    cut = names.select("subject", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("parts")).select(
        "subject", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "_").alias("concept"), F.array_join(F.expr("slice(parts, k + 1, size(parts))"), "_").alias("suffix")
    )
    known = cut.join(F.broadcast(pairs.select("concept").distinct()), "concept")
    own = pairs.withColumn("registered", F.lit(True))
    suffixes = pairs.select("suffix").distinct().withColumn("is_suffix", F.lit(True))
    return (
        known.join(F.broadcast(own), ["concept", "suffix"], "left").join(F.broadcast(suffixes), "suffix", "left")
        .select("subject", "concept", "suffix", F.when(F.col("suffix") == "", "missing").when(F.col("registered"), "valid").when(F.col("is_suffix"), "wrong").alias("verdict"))
        .filter("verdict is not null")
    )


#: Order of line items; the columns after the line number settle repeated ones.
_ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")


def adjacent_order(spark, directory):
    """Misordered neighbours of ordered groups (W1, W2): orders hold line items, an item whose ship mode is unknown breaks the chain."""
    order = Window.partitionBy("l_orderkey").orderBy(*_ITEM_ORDER)
    items = table(spark, directory, "lineitem").select("l_orderkey", "l_returnflag", *_ITEM_ORDER)
    key = F.when(F.col("l_returnflag") != "A", F.struct(F.col("l_returnflag").alias("k"), F.col("l_suppkey").alias("s")))
    marked = items.withColumn("key", key).withColumn("before", F.lag("key").over(order))
    return marked.filter(F.col("before") > F.col("key")).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))


def group_islands(spark, directory):
    """Islands of neighbouring line items with one flag (W2, gaps and islands)."""
    order = Window.partitionBy("l_orderkey").orderBy(*_ITEM_ORDER)
    marked = table(spark, directory, "lineitem").select("l_orderkey", "l_returnflag", *_ITEM_ORDER).withColumn("new", F.coalesce((F.lag("l_returnflag").over(order) != F.col("l_returnflag")).cast("int"), F.lit(1)))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("l_orderkey", "island").agg(F.count(F.lit(1)).alias("items"), F.min("l_linenumber").cast("bigint").alias("first_line"))


def finding_priority(spark, directory):
    """The one finding that stands for a subject at a position (C25, W5): highest grade, then rule rank, then id."""
    rows = _findings(spark, directory).filter("subject is not null").join(F.broadcast(catalog.rules(spark).select("rule", "rule_rank", "grade_rank")), "rule", "left")
    # max_by over a struct keeps the aggregation map-side, where row_number would gather a hot subject
    best = F.min(F.struct(F.coalesce("grade_rank", F.lit(9)).alias("g"), F.coalesce("rule_rank", F.lit(99)).alias("r"), F.col("finding_id").alias("finding_id"), F.col("rule").alias("rule")))
    return rows.groupBy("path", "line_no", "subject").agg(best.alias("b")).select("path", "line_no", "subject", "b.finding_id", "b.rule")


def identity_width(spark, directory):
    """Widest subject of each path (C22, G16, W6): the description column is one past it."""
    return _findings(spark, directory).filter("subject is not null").groupBy("path").agg((F.max(F.length("subject")) + 1).cast("bigint").alias("description_column"))


def owner_ambiguity(spark, directory):
    """Names that a path declares more than once."""
    rows = _findings(spark, directory).filter("subject is not null").select("path", "subject", "line_no").distinct()
    return rows.groupBy("path", "subject").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1")


def canonical_facts(spark, directory):
    """Order-insensitive digest of the header facts (U3, I1), a row per shard: sums of the words of their hashes, so that no group is gathered."""
    digest = F.sha2(F.concat_ws("\t", "path", "profile").cast("binary"), 256)
    words = [F.sum(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("bigint")).alias(f"sum_{k}") for k in range(8)]
    rows = header_profiles(spark, directory).select(F.substring(F.sha2("path", 256), 1, 2).alias("shard"), digest.alias("digest"))
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("facts"), *words)
