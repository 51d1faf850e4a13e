"""Licence of each code file and repository (problem 6).

A multi-pattern automaton over normalized words finds identifiers, titles with their edition and distinctive clauses of the licences in a
catalogue.  Ordered rules read what a text says with them (:meth:`Matcher.read`): denied and former licences do not count, an edition "or later"
allows its successors, an exception makes another licence where the catalogue has it, "or" leaves a choice, anything else that names several
binds to all.  Contents are read once; per-file findings are small rows, licence files are resolved per directory, directories inherit from
their ancestors, and files meet only the directory table, salted because one directory may hold a third of all files.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.lexing import EXTENSION_LANGUAGE
from factloom.llm.common import checkpointed, scan
from factloom.sources.tables import bounded, table

#: Bound of the licence catalogue that is sent to the workers, rows; and copies of the directory table in the salted join.
CATALOGUE_ROWS, SALTS = 10_000, 16
_WORD = re.compile(r"\d+(?:\.\d+)*|(?<=\d)\+|[^\W\d_]+?(?=[vV]\d)|[vV](?=\d)|[^\W\d_]+")
_ZEROS = re.compile(r"(?:\.0+)+$")
#: Words that only introduce an edition; words before a name that take it back, and after it that open or extend it.
_INTRODUCE = frozenset("v version edition licence license ver".split())
_DENY = re.compile(r"(?: not| never| neither| nor| without| formerly| previously| originally| no longer| instead of| rather than| unlike)(?: under| subject to| covered by| licensed| distributed| released| available| the| terms| of| a| an| any)* $")
_LATER = re.compile(r" ?(?:only )?(?:or|and)(?: any| at your option any| all)? (?:later|newer|higher|above|successor)\b| ?\+")
_EXCEPTION = re.compile(r" ?with (?:the )?((?:\S+ ){1,4}?)exception(?: (\d\S*))?")
_OR = re.compile(r"^(?: \S+){0,5}? (?:or|oder|ou|или)(?: \S+){0,5} $")
_OR_LATER = re.compile(r"or(?: any| at your option any)? (?:later|newer|higher|above)")
_LEAD = re.compile(r"(?:\s*(?:#(?!\s*(?:include|define|ifndef|ifdef|if|pragma|endif|undef|else|error)\b)(?!!?\[)[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->))*")
_LICENCE_NAME = r"(?i)^(un)?(licen[sc]es?|copying|copyright)([-_.][^/]*)?$"


def normalised(text: str) -> str:
    """Words and numbers in lower case between single blanks, trailing ``.0`` of numbers and the words that only introduce an edition dropped."""
    return " " + " ".join(_ZEROS.sub("", w) for w in map(str.lower, _WORD.findall(text)) if w not in _INTRODUCE) + " "


class Statement(NamedTuple):
    """What a text says: its licences in text order, whether they are a choice, those that agree with each, and the exceptions it names."""

    stated: list[str]
    choice: bool
    allowed: list[str]
    exceptions: list[str]


NOTHING = Statement([], False, [], [])


class Matcher:
    """Patterns of a catalogue: ``code edition``, ``title edition`` and every clause that only one licence has."""

    def __init__(self, catalogue: list[tuple[str, str, str, str]]):
        self.patterns: dict[str, set[tuple[str, str]]] = {}
        editions: dict[str, list[tuple[tuple, str]]] = {}
        for license_id, title, edition, _ in catalogue:
            if title and edition:
                editions.setdefault(normalised(title), []).append((tuple(int(x) for x in re.findall(r"\d+", edition)), license_id))
        self.successors = {own: [other for later, other in sorted(group) if later > edition] for group in editions.values() for edition, own in group}
        self.ids = {normalised(license_id): license_id for license_id, *_ in catalogue}
        self.clauses: dict[str, int] = {}
        clause_owner: dict[str, set[str]] = {}
        for license_id, title, edition, body in catalogue:
            code = re.sub(rf"[-_ ]?v?{re.escape(edition or '')}$", "", license_id) if edition else license_id
            for pattern in (normalised(f"{code} {edition or ''}"), normalised(f"{title or ''} {edition or ''}") if title else ""):
                if pattern.strip() and (edition or len(pattern.split()) > 2):
                    self.patterns.setdefault(pattern, set()).add((license_id, "name"))
            for clause in re.split(r"(?<=[.;])\s+", body or ""):
                if len(_WORD.findall(clause)) >= 5:
                    clause_owner.setdefault(normalised(clause), set()).add(license_id)
        for clause, owners in clause_owner.items():
            # a clause that another licence's clause contains is no evidence
            inside = {o for other, own in clause_owner.items() if other != clause and clause.strip() in other for o in own}
            if len(owners | inside) == 1:
                owner = next(iter(owners))
                self.patterns.setdefault(clause, set()).add((owner, "clause"))
                self.clauses[owner] = self.clauses.get(owner, 0) + 1
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def read(self, text: str) -> Statement:
        """Licences that a text names or quotes, by ordered rules.

        1. The longest of overlapping names counts.  2. A name that is denied or called former does not.  3. A name with an exception, or one that
        says "or later", is the catalogue's licence of that name where there is one; else "or later" allows the successors of the edition.  4. A
        licence is quoted by more than half of its distinctive clauses.  5. Names joined by "or" are a choice unless something else is stated too.
        """
        import ahocorasick

        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for pattern, what in self.patterns.items():
                self.automaton.add_word(pattern, (pattern, what))
            if self.patterns:
                self.automaton.make_automaton()
        if not self.patterns:
            return NOTHING
        words = normalised(text)
        named, quoted = [], {}
        for end, (pattern, what) in self.automaton.iter(words):
            for license_id, kind in sorted(what):
                if kind == "name":
                    named.append((end + 1 - len(pattern), end + 1, license_id))
                else:
                    quoted.setdefault(license_id, set()).add(pattern)
        whole = [n for n in named if not any(o[0] <= n[0] and n[1] <= o[1] and o[1] - o[0] > n[1] - n[0] for o in named)]
        found, allowed, exceptions, ends = [], {}, [], []
        for start, end, license_id in sorted(whole):
            if _DENY.search(words[max(0, start - 80) : start + 1]):
                continue
            later, exception = _LATER.match(words, end), _EXCEPTION.match(words, end - 1) or _EXCEPTION.match(words, end)
            stop = (later or exception).end() + 1 if later or exception else end
            own = license_id
            if exception:
                exceptions.append(" ".join(exception[1].split() + [exception[2]] * bool(exception[2])))
                own = self.ids.get(normalised(words[start:stop]), license_id)
            elif later:
                own = self.ids.get(normalised(words[start:end] + " or later"), license_id)
                allowed.setdefault(own, set()).update(self.successors.get(license_id, ()))
            found.append(own)
            ends.append((start, stop))
        quotes = sorted(k for k, v in quoted.items() if 2 * len(v) > self.clauses[k])
        stated = list(dict.fromkeys([*found, *quotes]))
        joined = [_OR.match(words[ends[k][1] - 1 : ends[k + 1][0] + 1]) is not None for k in range(len(ends) - 1)]
        distinct = [k for k in range(len(ends) - 1) if found[k] != found[k + 1]]
        choice = len(stated) > 1 and set(quotes) <= set(found) and bool(distinct) and all(joined[k] for k in distinct)
        agreeing = set(stated) if choice else set(stated[:1])
        for one in list(agreeing):
            agreeing |= allowed.get(one, set())
        return Statement(stated, choice, sorted(agreeing), sorted(set(exceptions)))

    def stated(self, text: str) -> list[str]:
        """Licences that a text names or quotes, sorted."""
        return sorted(self.read(text).stated)


def _judged(stated) -> F.Column:
    """One licence, ``conflict`` for several, ``unknown`` for none."""
    return F.when(F.size(stated) == 1, F.element_at(stated, 1)).when(F.size(stated) > 1, "conflict").otherwise("unknown")


_STATED = "file_id bigint, repo string, revision string, folder string, kind string, stated array<string>, choice boolean, allowed array<string>, exceptions array<string>"


def statements(spark: SparkSession, directory: str) -> DataFrame:
    """What each managed file says in its leading comments and each licence file in its whole text, a row per file; other files have empty rows."""
    catalogue = [
        (r.license_id, r.title, r.edition, r.body)
        for r in bounded(table(spark, directory, "license_catalog").filter(F.col("license_id").isNotNull()).select("license_id", "title", "edition", "body").distinct(), CATALOGUE_ROWS, "license_catalog")
    ]
    matcher = spark.sparkContext.broadcast(Matcher(catalogue))
    extensions = "|".join(["h", *EXTENSION_LANGUAGE])
    name = F.substring_index("relative_path", "/", -1)
    kind = F.when(F.col("relative_path").rlike(rf"\.({extensions})$"), "code").when(name.rlike(_LICENCE_NAME), "licence").otherwise("other")
    rows = (
        table(spark, directory, "source_documents")
        .filter(F.col("file_id").isNotNull() & F.col("relative_path").isNotNull())
        .select("file_id", "revision", "relative_path", kind.alias("kind"), F.when(kind != "other", F.col("content")).alias("content"))
    )

    def per_slice(columns):
        for file_id, revision, path, what, content in zip(*(columns[c] for c in ("file_id", "revision", "relative_path", "kind", "content"))):
            read = NOTHING
            if content and what != "other":
                text = content.decode("utf-8", "replace").lstrip("﻿")
                read = matcher.value.read(text[: _LEAD.match(text).end()] if what == "code" else text)
            repo, _, rest = path.partition("/")
            yield file_id, repo, revision, path.rpartition("/")[0] if rest else "", what, *read

    return checkpointed(scan(rows, per_slice, _STATED).dropDuplicates(["file_id"]))


def _folders(rows: DataFrame, found: DataFrame) -> DataFrame:
    """What each folder with managed files takes from the nearest licence file in it or above, up to the repository's root."""
    up = F.expr("transform(sequence(1, size(split(folder, '/'))), n -> struct(n as depth, substring_index(folder, '/', n) as above))")
    folders = rows.filter(F.col("kind") == "code").select("revision", "folder").distinct().withColumn("up", F.explode(up)).select("revision", "folder", "up.*")
    held = found.select(F.col("revision").alias("_revision"), F.col("folder").alias("above"), "license")
    return (
        folders.join(held, (F.col("revision").eqNullSafe(F.col("_revision"))) & (folders["above"] == held["above"]))
        .groupBy("revision", "folder")
        .agg(F.max_by("license", "depth").alias("inherited"))
    )


def _resolved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Licence of each managed file, and of each repository by the licence files in its root."""
    # a licence file that leaves a choice stands for the first one it names
    one = F.explode_outer(F.when(F.col("choice"), F.slice("stated", 1, 1)).otherwise(F.col("stated"))).alias("one")
    licence_files = rows.filter(F.col("kind") == "licence").select("repo", "revision", "folder", one)
    found = (
        licence_files.groupBy("revision", "folder")
        .agg(F.array_sort(F.collect_set("one")).alias("set"))
        .select("revision", "folder", _judged(F.col("set")).alias("license"))
    )
    folders = _folders(rows, found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(
        F.col("revision").alias("_revision"), F.col("folder").alias("_folder"), "inherited", "salt"
    )
    code = rows.filter(F.col("kind") == "code").withColumn("_salt", F.pmod("file_id", F.lit(SALTS)).cast("int"))
    inherited = F.coalesce("inherited", F.lit("unknown"))
    several = (F.size("stated") > 1) & ~F.col("choice")
    known = ~inherited.isin("unknown", "conflict")
    own = F.when(F.col("choice") & F.array_contains("stated", inherited), inherited).otherwise(F.element_at("stated", 1))
    license_id = (
        F.when(F.size("stated") == 0, inherited).when(several, "conflict").when(known & ~F.array_contains("allowed", inherited), "conflict").otherwise(own)
    )
    files = code.join(
        folders, (F.col("folder") == F.col("_folder")) & F.col("revision").eqNullSafe(F.col("_revision")) & (F.col("_salt") == F.col("salt")), "left"
    ).select("repo", "file_id", license_id.alias("license_id"))
    roots = licence_files.filter(F.col("folder") == F.col("repo")).groupBy("repo").agg(F.array_sort(F.collect_set("one")).alias("set"))
    repositories = (
        rows.select("repo").distinct().join(roots, "repo", "left")
        .select("repo", F.lit(-1).cast("bigint").alias("file_id"), _judged(F.coalesce("set", F.array().cast("array<string>"))).alias("license_id"))
    )
    return files, repositories


def licenses(spark: SparkSession, directory: str) -> DataFrame:
    """``p6_found(repo, file_id, license_id)``: a row for each managed file and one with ``file_id`` -1 for each repository.

    A choice is the licence the file would otherwise take where that is among the choices, else the first named; an edition "or later" agrees with
    an inherited later one.  Null contents and empty files state nothing; a null path has no row.
    """
    files, repositories = _resolved(statements(spark, directory))
    return files.unionByName(repositories)


def terms(spark: SparkSession, directory: str) -> DataFrame:
    """``p6_terms(file_id, stated, choice, allowed, exceptions)``: what each managed or licence file that says anything says."""
    rows = statements(spark, directory).filter("kind <> 'other' and size(stated) > 0")
    return rows.select("file_id", F.array_join("stated", " ").alias("stated"), "choice", F.array_join("allowed", " ").alias("allowed"), F.array_join("exceptions", "; ").alias("exceptions"))


def repositories(spark: SparkSession, directory: str) -> DataFrame:
    """``p6_repositories``: each repository with the licence of its root, its managed files, and how many agree, differ, conflict or are unknown."""
    files, roots = _resolved(statements(spark, directory))
    counted = files.groupBy("repo", "license_id").agg(F.count(F.lit(1)).alias("n"))
    joined = roots.select("repo", F.col("license_id").alias("root")).join(counted, "repo", "left")
    of = lambda condition: F.sum(F.when(condition, F.coalesce("n", F.lit(0))).otherwise(0)).cast("bigint")
    named = ~F.col("license_id").isin("conflict", "unknown")
    return joined.groupBy("repo", F.col("root").alias("license_id")).agg(
        of(F.lit(True)).alias("files"), of(F.col("license_id") == F.col("root")).alias("agreeing"), of(named & (F.col("license_id") != F.col("root"))).alias("differing"),
        of(F.col("license_id") == "conflict").alias("conflicts"), of(F.col("license_id") == "unknown").alias("unknowns"), F.countDistinct(F.when(named, F.col("license_id"))).alias("licences"),
    )
