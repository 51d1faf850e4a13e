"""Generated, minified, vendored or data-only source files (problem 4).

One Arrow pass gives each file its signs (path, notices, layout, literals, repetition) and the winnowed fingerprints of its normalized token
stream: hashes of GRAM consecutive tokens, comments and layout dropped.  A file is a vendored copy when RECURRING of its fingerprints occur in
REPOSITORIES or more unrelated repositories.  Counting is exact and in steps that combine before their exchange, so no group is ever gathered.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.lexing import EXTENSION_LANGUAGE, tokens
from factloom.llm.common import checkpointed, managed_language, repository, scan
from factloom.llm.shared_spans import _window_minima
from factloom.sources.tables import table

#: Tokens of a fingerprint, fingerprints of a window, repositories that make a fingerprint common, share of common ones in a copy: files that were
#: edited after they were taken over count as own work.
GRAM, WINDOW, REPOSITORIES, RECURRING = 20, 40, 5, 0.9
#: Repositories with so many files or more are related when their file sketches agree; the sketches, each the least hash over the files.
SKETCHED_FILES, SKETCHES = 3, 8
#: Lines of one shape that make a file a listing, and their share.
REPEATED_LINES, REPEATED_SHARE = 9, 0.7

#: Directory names that stand for outside code and for tool output.
OUTSIDE_DIRECTORIES = frozenset(
    "vendor vendored third_party third-party thirdparty 3rdparty 3rd_party external externals extern deps node_modules bower_components subprojects contrib imported".split()
)
GENERATED_DIRECTORIES = frozenset("gen generated _generated _autogen autogen autogenerated __generated__".split())

_GENERATED = re.compile(
    r"@generated|\bauto-?generated\b|automatically (?:produced|generated|created)|\bgenerated (?:by|from|with|using|automatically)\b|machine[- ](?:made|generated)"
    r"|\b(?:was|were) (?:written|created|produced|emitted) by (?:\S*gen\b|\S*generator\b|\S+ v?\d+\.\d|\S+\.(?:py|sh|pl|rb|js)\b|an? (?:tool|script|program|generator)\b)|\boutput of \w+|do not (?:edit|modify)(?: (?:this file|by hand|manually)\b|\s*[.!]|\s+--)|edits will be (?:lost|overwritten)"
    r"|(?:automatisch|maschinell) (?:erzeugt|erstellt|generiert)|\berzeugt\b.*(?:überschrieben|nicht von hand)|nächsten lauf überschrieben"
    r"|自动生成|自動生成|générée? automatiquement|généré par|généré à partir|generado automáticamente|generado por|сгенерирован|создан автоматически|автоматически создан",
    re.I,
)
_OUTSIDE = re.compile(
    r"\bimported copy of\b|^\W*upstream:|\bsynced as is\b|^\W*origin \S+ v?\d|overwritten by the next sync|\b(?:taken|copied|adopted|borrowed|ported|lifted) (?:verbatim )?from (?:the )?(?:project|\S+ v?\d)"
    r"|\bvendored (?:from|copy)\b|send (?:fixes|patches|changes) upstream|fremdprojekt|übernommen aus|取自|摘自|来自.{0,12}项目|(?:从|由).{0,40}(?:引入|复制|移植|同步)|から(?:取り込|移植|コピー)"
    r"|(?:repris|copié|importé|tiré) d[ue']|(?:tomado|copiado|importado) de(?:l)? (?:proyecto )?|(?:взят[оа]?|скопирован[оа]?|заимствован[оа]?) из",
    re.I | re.M,
)
_LEAD = re.compile(r"(?:\s*(?:#(?!\s*(?:include|define|ifndef|ifdef|if|pragma|endif|undef|else|error)\b)(?!!?\[)[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->))*")
_COMMENT_START = re.compile(r"[ \t]*(?:#(?!\s*(?:include|define|ifndef|ifdef|if|pragma|endif|undef|else|error)\b)|//)")
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xXbBoO][\da-fA-F_']+|\d[\d_']*\.?\d*(?:[eE][-+]?\d+)?)(?:[uUlLfF]*|[iuf]\d+)(?!\w)")
_LONG_STRING = re.compile(r"[\"'][A-Za-z0-9+/=\\]{40,}[\"']")
_OPEN_ENDS = frozenset("0123456789gshipa")
_SHAPE = re.compile(r"0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?|(?<![A-Za-z])(?:get|set|has|is|put|add)(?=_)")
_COMMENTS = re.compile(r"(?m)^[ \t]*(?://|#(?!\s*(?:include|define|if|endif|pragma|\[))).*\n?|/\*[\s\S]*?\*/")


def _trailing(text: str, lead: int) -> int:
    """Where the comments that end a file begin, however long they are; the length of the text when it ends in code."""
    begin, end = len(text), len(text.rstrip())
    while end > lead:
        line = text.rfind("\n", 0, end) + 1
        if text.endswith("*/", 0, end):
            line = text.rfind("/*", lead, end)
            if line < 0:
                break
        elif not _COMMENT_START.match(text, line, end):
            break
        begin, end = line, len(text[:line].rstrip())
    return max(begin, lead)


def signs(path: str, text: str) -> list[str]:
    """Reasons why a file is not hand-written source of its own project, from its path and text alone."""
    out = []
    directories = {x.lower() for x in path.split("/")[1:-1]}
    if directories & OUTSIDE_DIRECTORIES:
        out.append("outside_directory")
    if directories & GENERATED_DIRECTORIES or "/build/out/" in path:
        out.append("generated_directory")
    lead = _LEAD.match(text).end()
    tail = _trailing(text, lead)
    for notice in (text[:lead], text[tail:]):
        if notice and _GENERATED.search(notice):
            out.append("generated_notice")
        if notice and _OUTSIDE.search(notice):
            out.append("outside_notice")
    body = text[lead:tail].strip()
    if body:
        lines = [x for x in body.split("\n") if x and not x.isspace()]
        dense = len("".join(body.split()))
        literal = sum(map(len, _LONG_STRING.findall(body)))
        if 1 - dense / len(body) < 0.1 and (len(body) / len(lines) > 160 or sorted(map(len, lines))[-max(1, len(lines) // 10)] > 500) and literal < 0.5 * dense:
            out.append("minified")
        code = _COMMENTS.sub("", body)
        solid = len("".join(code.split()))
        # digits are a third of a decimal number at least, and a hexadecimal one has 24 characters at most: fewer cannot make half of the code
        if literal + 3 * sum(map(code.count, "0123456789")) + 24 * (code.count("0x") + code.count("0X")) > 0.5 * solid:
            numbers = literal + sum(map(len, _NUMBER.findall(code)))
            if numbers > 0.5 * (solid or 1):
                out.append("data")
        # lines of one shape begin and end alike, but for numbers and the verbs that a shape leaves out
        ends = Counter((x[0] if x[0] not in _OPEN_ENDS else "0") + ("0" if x[-1].isalnum() else x[-1]) for x in map(str.strip, lines))
        if len(lines) >= REPEATED_LINES and max(ends.values()) > REPEATED_SHARE * len(lines):
            shapes: dict[str, int] = {}
            for line in _SHAPE.sub("0", body).split("\n"):
                shape = line.strip()
                if shape:
                    shapes[shape] = shapes.get(shape, 0) + 1
            top = max(shapes, key=shapes.get)
            if shapes[top] >= REPEATED_LINES and shapes[top] > REPEATED_SHARE * len(lines) and len(top) > 8:
                out.append("repetitive")
    return out


class _TokenHashes(dict):
    """64-bit hash of a token's normal form: comments have none, blanks inside directives are alike."""

    def __missing__(self, token: str) -> int:
        comment = token.startswith(("//", "/*")) and len(token) > 1
        value = 0 if comment else xxhash.xxh64_intdigest(" ".join(token.split())) | 1
        if len(self) > 200_000:
            self.clear()
        if len(token) < 60:
            self[token] = value
        return value


_hashes = _TokenHashes()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def fingerprints(text: str, language: str) -> np.ndarray:
    """Winnowed fingerprints of the token stream: the least hash of each WINDOW of GRAM-token runs; a stream shorter than that has one in all."""
    lexed = tokens(text, language)
    if language == "python":
        lexed = [t for t in lexed if t[0] != "#"]
    stream = np.fromiter(map(_hashes.__getitem__, lexed), np.uint64, len(lexed))
    stream = stream[stream != 0]
    if not len(stream):
        return np.empty(0, np.int64)
    gram = min(GRAM, len(stream))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(stream * np.cumprod(np.full(len(stream), _BASE, np.uint64)))])
        grams = (sums[gram:] - sums[:-gram]) * np.cumprod(np.full(len(stream) - gram + 1, _INVERSE, np.uint64))
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
    return np.unique(_window_minima(grams, min(WINDOW, len(grams)))).view(np.int64)


def profiled_files(spark: SparkSession, directory: str) -> DataFrame:
    """``(file_id, relative_path, signs, prints)`` of each delivery of a managed or ``.js`` file; bytes that are no UTF-8 are replaced."""
    extensions = "|".join(["h", "js", *EXTENSION_LANGUAGE])
    rows = (
        table(spark, directory, "source_documents")
        .select("file_id", "relative_path", "content")
        .filter(F.col("file_id").isNotNull() & F.col("relative_path").rlike(rf"\.({extensions})$"))
    )

    def per_slice(columns):
        for file_id, path, content in zip(columns["file_id"], columns["relative_path"], columns["content"]):
            text = (content or b"").decode("utf-8", "replace")
            language = managed_language(path)
            prints = fingerprints(text, language if language in ("python", "rust") else "cpp")
            yield file_id, path, signs(path, text), prints.tolist()

    return scan(rows, per_slice, "file_id bigint, relative_path string, signs array<string>, prints array<bigint>")


def _common(files: DataFrame, prints: DataFrame) -> DataFrame:
    """Fingerprints that REPOSITORIES or more unrelated repositories have.

    Repositories of SKETCHED_FILES or more different files are related as far as their SKETCHES agree, each being equal with the probability that
    two repositories share a file: copies of one repository count once, and the least count over the sketches decides.
    """
    held = prints.select("print", "repo").distinct()
    often = held.groupBy("print").agg(F.count(F.lit(1)).alias("repos")).filter(F.col("repos") >= REPOSITORIES).select("print")
    different = files.filter(F.size("prints") > 0).select(repository().alias("repo"), F.xxhash64("prints").alias("stream")).distinct()
    own = [F.xxhash64(F.lit(k), "repo") for k in range(SKETCHES)]
    sketches = different.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), *[F.min(F.xxhash64(F.lit(k), "stream")).alias(f"s{k}") for k in range(SKETCHES)])
    families = sketches.select("repo", *[F.when(F.col("files") >= SKETCHED_FILES, F.col(f"s{k}")).otherwise(own[k]).alias(f"s{k}") for k in range(SKETCHES)])
    counted = held.join(often, "print", "left_semi").join(families, "repo").groupBy("print").agg(*[F.countDistinct(f"s{k}").alias(f"n{k}") for k in range(SKETCHES)])
    return counted.filter(F.least(*[F.col(f"n{k}") for k in range(SKETCHES)]) >= REPOSITORIES).select("print")


def flagged(spark: SparkSession, directory: str) -> DataFrame:
    """``(file_id, relative_path, signs)`` of every file that is not hand-written source; empty files have no signs.

    A fingerprint counts once per repository; a file is a vendored copy when RECURRING of its fingerprints occur in REPOSITORIES or more.
    Files already flagged by their signs take part in the counts as well.
    """
    files = checkpointed(profiled_files(spark, directory))
    prints = files.select("file_id", repository().alias("repo"), F.explode("prints").alias("print"))
    common = _common(files, prints)
    copies = (
        prints.join(common, "print", "left_semi")
        .groupBy("file_id")
        .agg(F.countDistinct("print").alias("shared"))
    )
    own = files.select("file_id", "relative_path", "signs", F.size("prints").alias("all_prints")).dropDuplicates(["file_id"])
    return (
        own.join(copies, "file_id", "left")
        .withColumn("signs", F.when(F.col("shared") >= RECURRING * F.col("all_prints"), F.concat("signs", F.array(F.lit("recurring")))).otherwise(F.col("signs")))
        .filter(F.size("signs") > 0)
        .select("file_id", "relative_path", F.array_join(F.array_sort(F.array_distinct("signs")), " ").alias("signs"))
    )


def found(spark: SparkSession, directory: str) -> DataFrame:
    """``p4_found(file_id)``."""
    return flagged(spark, directory).select("file_id")
