"""The fixed rule catalogue, fact families, directives and forms, as literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rule, grade, chapter; the position is the presentation rank.
RULES = (
    ("source.parseability", "hard_violation", "source"),
    ("source.trailing_comment", "hard_violation", "source"),
    ("source.comment_punctuation", "hard_violation", "source"),
    ("source.comment_parentheses", "review_required", "source"),
    ("identifier.candidate", "review_required", "identifier"),
    ("identifier.unknown_token", "review_required", "identifier"),
    ("identifier.canonical_form", "hard_violation", "identifier"),
    ("identifier.reserved", "hard_violation", "identifier"),
    ("identifier.representation_suffix", "hard_violation", "identifier"),
    ("documentation.carrier", "hard_violation", "documentation"),
    ("documentation.summary", "hard_violation", "documentation"),
    ("documentation.public_contract", "hard_violation", "documentation"),
    ("documentation.punctuation", "hard_violation", "documentation"),
    ("documentation.parentheses", "review_required", "documentation"),
    ("documentation.safety", "hard_violation", "documentation"),
    ("dependency.wildcard", "hard_violation", "dependency"),
    ("dependency.order", "hard_violation", "dependency"),
    ("dependency.module_placement", "hard_violation", "dependency"),
)
#: The six fact families in their order, and the grades in theirs.
FAMILIES = ("capture", "physical_lines", "structure", "identifier", "documentation", "dependency_declaration")
GRADES = ("hard_violation", "review_required")
#: Transliterated Greek letters that are candidate names.
GREEK = "alpha beta chi delta epsilon eta gamma iota kappa lambda mu nu omega omicron phi pi psi rho sigma tau theta upsilon xi zeta".split()
#: Role prefixes that are allowed and those that are not.
ROLE_PREFIXES = "is has can should needs lower upper minimum maximum".split()
FORBIDDEN_PREFIXES = ("min", "max")


def rules(spark: SparkSession) -> DataFrame:
    """``(rule, grade, chapter, rule_rank, grade_rank)``, a table of eighteen rows."""
    rows = [(rule, grade, chapter, rank, GRADES.index(grade)) for rank, (rule, grade, chapter) in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule string, grade string, chapter string, rule_rank int, grade_rank int")


def families(spark: SparkSession) -> DataFrame:
    """``(family, family_ordinal)``, six rows."""
    return spark.createDataFrame(list(zip(FAMILIES, range(6))), "family string, family_ordinal int")
