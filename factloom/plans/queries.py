"""Queries over the stored tables by name, and the SQL that states the same result."""

from __future__ import annotations

from factloom.operators import tables as t
from factloom.plans import catalog, review

_PATH = r"regexp_replace(replace({}, '\', '/'), '^(\./)+', '')"
_RULES = "(VALUES " + ", ".join(f"('{r}', '{c}', {k}, {catalog.GRADES.index(g)})" for k, (r, g, c) in enumerate(catalog.RULES)) + ") AS r(rule, chapter, rule_rank, grade_rank)"
_FAMILIES = "(VALUES " + ", ".join(f"('{f}', {k})" for k, f in enumerate(catalog.FAMILIES)) + ") AS fam(family, family_ordinal)"
_FINDINGS = f"f AS (SELECT DISTINCT ON (finding_id) finding_id, revision, rule, grade, line_no, column_no, subject, {_PATH.format('path')} AS path FROM findings WHERE finding_id IS NOT NULL)"
_CELLS = f"c AS (SELECT DISTINCT ON (revision, path, family) * FROM (SELECT revision, {_PATH.format('path')} AS path, family, state, fact_count, reason FROM coverage))"
_FILES = f"d AS (SELECT DISTINCT ON (file_id) file_id, {_PATH.format('relative_path')} AS path, content FROM source_documents WHERE file_id IS NOT NULL)"
_HEADERS = "h AS (SELECT path, min(profile) AS profile FROM header_languages GROUP BY path)"
_LANGUAGE = """CASE regexp_extract(path, '\\.([^./]*)$', 1) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'c' WHEN 'cc' THEN 'cpp' WHEN 'cpp' THEN 'cpp' WHEN 'cxx' THEN 'cpp'
 WHEN 'hpp' THEN 'cpp' WHEN 'hh' THEN 'cpp' WHEN 'hxx' THEN 'cpp' WHEN 'h' THEN CASE WHEN profile = 'cpp' THEN 'cpp' ELSE 'c' END END"""
_ADMITTED = f"{_FILES}, {_HEADERS}, l AS (SELECT file_id, path, content, {_LANGUAGE} AS language FROM d LEFT JOIN h USING (path))"
_TEXT = "try(decode(content))"
_LINES = "(length({0}) - length(replace({0}, chr(10), '')) + CASE WHEN length({0}) > 0 AND {0} NOT LIKE '%' || chr(10) THEN 1 ELSE 0 END)::BIGINT"
_PAIRS = "(VALUES " + ", ".join(f"('{c}', '{s}')" for c, own in t.QUANTITIES.items() for s in own) + ") AS q(concept, suffix)"
_GREEK = ", ".join(f"'{g}'" for g in catalog.GREEK)
_TOKENS = r"""tok AS (SELECT subject, pos - 1 AS pos, parts[pos] AS token FROM (SELECT subject, parts, unnest(range(1, len(parts) + 1)) AS pos FROM
 (SELECT DISTINCT subject, string_split(regexp_replace(regexp_replace(subject, '^_+|^r#|^''|_t$|_$', '', 'g'), '([a-z])([A-Z])', '\1_\2', 'g'), '_') AS parts FROM findings WHERE subject IS NOT NULL)) WHERE parts[pos] <> '')"""

ORACLE = {
    "language_admission": f"WITH {_ADMITTED} SELECT file_id, path, language FROM l",
    "duplicate_contents": f"WITH {_FILES} SELECT sha256(content) AS digest, count(*)::BIGINT AS files, min(file_id) AS first_file FROM d GROUP BY 1 HAVING count(*) > 1",
    "duplicate_paths": f"SELECT {_PATH.format('path')} AS path, count(DISTINCT findings.path)::BIGINT AS spellings FROM findings WHERE findings.path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT findings.path) > 1",
    "admission_by_profile": f"""WITH {_ADMITTED}, b AS (SELECT DISTINCT {_PATH.format('file')} AS path FROM blocked WHERE family = 'structure')
SELECT language, count(*)::BIGINT AS candidates, count(*) FILTER (path NOT IN (SELECT path FROM b))::BIGINT AS admitted, round(count(*) FILTER (path NOT IN (SELECT path FROM b)) / count(*), 6) AS ratio
FROM l WHERE language IS NOT NULL GROUP BY language""",
    "finding_summary": f"WITH {_FINDINGS} SELECT count(*)::BIGINT AS total, count(*) FILTER (grade = 'hard_violation')::BIGINT AS hard_violation, count(*) FILTER (grade = 'review_required')::BIGINT AS review_required FROM f",
    "rule_grade_counts": f"WITH {_FINDINGS} SELECT grade, rule, count(*)::BIGINT AS findings FROM f GROUP BY grade, rule",
    "presentation_order": f"""WITH {_FINDINGS} SELECT finding_id, CASE grade WHEN 'hard_violation' THEN 0 WHEN 'review_required' THEN 1 ELSE 2 END::INT AS grade_rank, chapter, rule_rank::INT AS rule_rank,
 path, line_no, column_no, subject FROM f LEFT JOIN {_RULES} USING (rule)""",
    "chapter_counts": f"WITH {_FINDINGS} SELECT chapter, count(*)::BIGINT AS findings FROM f JOIN {_RULES} USING (rule) GROUP BY chapter",
    "coverage_cells": f"""WITH {_CELLS}, g AS (SELECT * FROM (SELECT DISTINCT revision, path FROM c) CROSS JOIN {_FAMILIES})
SELECT revision, path, family, family_ordinal::INT AS family_ordinal, coalesce(state, 'blocked') AS state, fact_count::BIGINT AS fact_count FROM g LEFT JOIN c USING (revision, path, family)""",
    "family_totals": f"WITH {_CELLS} SELECT family, count(*)::BIGINT AS cells, count(*) FILTER (state = 'blocked')::BIGINT AS blocked, sum(coalesce(fact_count, 0))::BIGINT AS facts FROM c GROUP BY family",
    "file_completion": f"WITH {_CELLS} SELECT revision, path, count(*) FILTER (state = 'blocked')::BIGINT AS blocked_families, CASE WHEN bool_or(state = 'blocked') THEN 'incomplete' ELSE 'complete' END AS completion FROM c GROUP BY revision, path",
    "disposition": f"""WITH {_CELLS}, {_FINDINGS}, a AS (SELECT revision, bool_or(state = 'blocked') AS b FROM c GROUP BY revision), n AS (SELECT revision, count(*) AS k FROM f GROUP BY revision)
SELECT revision, CASE WHEN b THEN 'incomplete' ELSE 'complete' END AS completion, CASE WHEN b THEN 'incomplete' WHEN coalesce(k, 0) > 0 THEN 'findings' ELSE 'clean' END AS disposition FROM a LEFT JOIN n USING (revision)""",
    "blocked_details": f"""SELECT revision, file, family, family_ordinal::INT AS family_ordinal, coalesce(string_agg(reason, '; ' ORDER BY reason), '') AS reason, count(reason)::BIGINT AS reasons
FROM (SELECT DISTINCT revision, {_PATH.format('file')} AS file, family, reason FROM blocked) JOIN {_FAMILIES} USING (family) GROUP BY revision, file, family, family_ordinal""",
    "blocked_against_coverage": f"""WITH {_CELLS} SELECT revision, path, family FROM c WHERE state = 'blocked'
AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.revision = c.revision AND {_PATH.format('b.file')} = c.path AND b.family = c.family)""",
    "unresolved_positions": rf"""SELECT file, regexp_extract(reason, 'at (\d+):(\d+)', 1)::BIGINT AS line, regexp_extract(reason, 'at (\d+):(\d+)', 2)::BIGINT AS column_no, reason
FROM (SELECT DISTINCT {_PATH.format('file')} AS file, reason FROM blocked) WHERE regexp_matches(reason, 'at (\d+):(\d+)')""",
    "nearest_rank_p95": "SELECT event_type, quantile_disc(value, 0.95) AS p95, max(value) AS most, count(*)::BIGINT AS runs FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "distinct_digests": "SELECT file_id, count(*)::BIGINT AS deliveries, count(DISTINCT sha256(content))::BIGINT AS digests FROM source_documents WHERE file_id IS NOT NULL GROUP BY file_id",
    "prose_findings": r"""WITH l AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS line FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
SELECT doc_id, line::BIGINT AS line, 'source.comment_punctuation' AS rule, 'hard_violation' AS grade FROM l WHERE regexp_matches(parts[line], '。|[A-Za-z)][.](\s|$)')
UNION ALL SELECT doc_id, line::BIGINT, 'source.comment_parentheses', 'review_required' FROM l WHERE regexp_matches(parts[line], '[()（）]')""",
    "physical_lines": f"SELECT doc_id, {_LINES.format('text')} AS lines FROM documents",
    "cjk_summaries": "SELECT doc_id, regexp_matches(string_split(text, chr(10))[1], '[一-鿿]{2}') AS has_summary FROM documents WHERE text IS NOT NULL",
    "identifier_tokens": f"WITH {_TOKENS} SELECT subject, pos::BIGINT AS pos, token, length(token) = 1 OR lower(token) IN ({_GREEK}) AS is_candidate FROM tok",
    "unknown_tokens": f"""WITH {_TOKENS}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS token FROM part)
SELECT lower(token) AS token, count(*)::BIGINT AS uses FROM tok WHERE length(token) > 1 AND lower(token) NOT IN ({_GREEK}) AND lower(token) NOT IN (SELECT token FROM w) GROUP BY 1""",
    "name_forms": f"""SELECT DISTINCT subject, CASE WHEN regexp_matches(subject, '^_?[a-z][a-z0-9]*(_[a-z0-9]+)*$') THEN 'lower_snake' WHEN regexp_matches(subject, '^_?[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$') THEN 'upper_snake'
 WHEN regexp_matches(subject, '^_?[A-Z][A-Za-z0-9]*$') THEN 'pascal' ELSE 'other' END AS form, regexp_matches(lower(subject), '^_?({'|'.join(catalog.ROLE_PREFIXES)})_') AS has_role,
 regexp_matches(lower(subject), '^_?((min|max)_|({'|'.join(catalog.ROLE_PREFIXES)})_({'|'.join(catalog.ROLE_PREFIXES)}|min|max)_)') AS bad_prefix FROM findings WHERE subject IS NOT NULL""",
    "quantity_suffixes": f"""WITH n AS (SELECT DISTINCT subject, string_split(lower(subject), '_') AS p FROM findings WHERE subject IS NOT NULL),
c AS (SELECT subject, array_to_string(p[1:k], '_') AS concept, coalesce(array_to_string(p[k + 1:], '_'), '') AS suffix FROM (SELECT subject, p, unnest(range(1, len(p) + 1)) AS k FROM n)),
q AS (SELECT * FROM {_PAIRS}),
v AS (SELECT subject, concept, suffix, CASE WHEN suffix = '' THEN 'missing' WHEN EXISTS (SELECT 1 FROM q WHERE q.concept = c.concept AND q.suffix = c.suffix) THEN 'valid'
 WHEN EXISTS (SELECT 1 FROM q WHERE q.suffix = c.suffix) THEN 'wrong' END AS verdict FROM c WHERE concept IN (SELECT concept FROM q))
SELECT subject, concept, suffix, verdict FROM v WHERE verdict IS NOT NULL""",
    "adjacent_order": """WITH m AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey, lag(l_returnflag) OVER w AS bf, lag(l_suppkey) OVER w AS bs FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice))
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM m WHERE l_returnflag <> 'A' AND bf <> 'A' AND (bf > l_returnflag OR (bf = l_returnflag AND bs > l_suppkey))""",
    "group_islands": """WITH m AS (SELECT *, coalesce((lag(l_returnflag) OVER w <> l_returnflag)::INT, 1) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice)),
i AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_orderkey, island::BIGINT AS island, count(*)::BIGINT AS items, min(l_linenumber)::BIGINT AS first_line FROM i GROUP BY 1, 2""",
    "finding_priority": f"""WITH {_FINDINGS}, j AS (SELECT f.*, row_number() OVER (PARTITION BY path, line_no, subject ORDER BY coalesce(grade_rank, 9), coalesce(rule_rank, 99), finding_id) AS n
 FROM f LEFT JOIN {_RULES} USING (rule) WHERE subject IS NOT NULL) SELECT path, line_no, subject, finding_id, rule FROM j WHERE n = 1""",
    "identity_width": f"WITH {_FINDINGS} SELECT path, (max(length(subject)) + 1)::BIGINT AS description_column FROM f WHERE subject IS NOT NULL GROUP BY path",
    "owner_ambiguity": f"WITH {_FINDINGS} SELECT path, subject, count(*)::BIGINT AS owners FROM (SELECT DISTINCT path, subject, line_no FROM f WHERE subject IS NOT NULL) GROUP BY 1, 2 HAVING count(*) > 1",
    "canonical_facts": f"""WITH {_HEADERS}, x AS (SELECT substr(sha256(path), 1, 2) AS shard, sha256(concat_ws(chr(9), path, profile)) AS g FROM h)
SELECT shard, count(*)::BIGINT AS facts, {', '.join(f"sum(('0x' || substr(g, {8 * k + 1}, 8))::BIGINT)::BIGINT AS sum_{k}" for k in range(8))} FROM x GROUP BY shard""",
    "capture_inventory": f"""WITH {_FILES} SELECT file_id, octet_length(content)::BIGINT AS n_bytes, try(decode(content)) IS NOT NULL AS valid,
 {_LINES.format(_TEXT)} AS lines, sha256(content) AS digest FROM d""",
    "profile_totals": f"""WITH {_ADMITTED}, x AS (SELECT language, octet_length(content) AS b, try(decode(content)) IS NOT NULL AS ok, coalesce({_LINES.format(_TEXT)}, 0) AS n FROM l WHERE language IS NOT NULL)
SELECT language, count(*)::BIGINT AS files, sum(n)::BIGINT AS lines, sum(b)::BIGINT AS n_bytes, count(*) FILTER (NOT ok)::BIGINT AS invalid FROM x GROUP BY language""",
}
QUERIES = {name: getattr(t, name) for name in ORACLE} | {
    "review_findings": review.stored_findings,
    "review_coverage": review.stored_coverage,
    "review_observations": review.stored_observations,
}
