"""Reading level of each document (problem 10).

A linear ranker is fitted on differences of graded document pairs over syntax and vocabulary features; isotonic regression turns its scores into
levels.  Features are computed for every document in one Arrow pass; only the bounded graded sample reaches the driver.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import scan
from factloom.sources.tables import table

#: Bound of the graded sample in documents and of the pairs drawn for each of them.
SAMPLE_DOCUMENTS, PAIRS_EACH = 5000, 24
LEVELS = (1, 2, 3)
FEATURES = ("sentence_words", "median_sentence", "word_letters", "long_words", "very_long_words", "short_words", "syllables", "commas", "subordination", "easy", "middle", "hard", "second_person")
_FENCE = re.compile(r"```[\s\S]*?(?:```|\Z)")
_CODE_LINE = re.compile(
    r"^\s*(?:(?:def|class|import|from|use|pub|fn|let|struct|impl|enum|trait|return|if|for|while|else|static|const|double|inline|namespace|template|#include|#define|#ifndef|#endif|#pragma|@\w+|raise|async)\b.*[;:{}()=,]\s*$"
    r"|.*[;{}]\s*$|\s*[})\]]+[;,]?\s*$|#include.*|import \w+|from \w+ import.*|use [\w:]+.*;|[\w.\[\]]+ [-+*/]?= .*|\s*\w+: \w+,\s*$|#(?:ifndef|define|endif|pragma).*)"
)
_COMMENT_LINE = re.compile(r"^\s*(?://|/\*|\*|#\s|\"\"\"|''')")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SENTENCE = re.compile(r"[.!?。！？]+(?:\s+|$)|\n\s*\n|\n(?=[-*#]|\w+: )")
_VOWELS = re.compile(r"[aeiouy]+")
#: Frequent English function words, and words that open a subordinate clause.
_FUNCTION = frozenset("the a an of to and or in on at by for with from as is are was were be been it its that this which who whose if so not no do does you your we our they them their can may must one two how what why when where then than but i my some all each every has have had before after".split())
_SUBORDINATE = frozenset("that which whose whom although though because since whereas whereby notwithstanding while unless until whether wherein thereby consequently insofar if when where before after".split())


def english_prose(text: str | None) -> str | None:
    """The prose of a document that is mainly English prose, else ``None``; fenced code inside it is left out."""
    if not text or not text.strip():
        return None
    outside = _FENCE.sub("\n\n", text.replace("\r\n", "\n"))
    lines = [x for x in outside.split("\n") if x.strip()]
    if not lines or len("".join(lines)) < 0.4 * len("".join(text.split())):
        return None
    code = [x for x in lines if _CODE_LINE.match(x) and len(_WORD.findall(x)) < 25]
    comments = [x for x in lines if _COMMENT_LINE.match(x) and not x.startswith(("# ", "* "))]
    if len(code) + len(comments) > 0.3 * len(lines) and len(code) >= 2:
        return None
    words = [w.lower() for w in _WORD.findall(outside)]
    if len(words) < 5 or sum(w in _FUNCTION for w in words) < 0.18 * len(words):
        return None
    if sum(1 for w in words if not w.isascii()) > 0.15 * len(words):
        return None
    skip = set(code)
    return "\n".join(x for x in outside.split("\n") if x not in skip)


def features(prose: str) -> list[float]:
    """Syntax and vocabulary features of a prose, robust against a few sentences of another level."""
    sentences = [[w.lower() for w in _WORD.findall(s)] for s in _SENTENCE.split(prose)]
    sentences = [s for s in sentences if len(s) > 1] or [["x"]]
    weights = np.array([len(s) for s in sentences], float)
    letters = np.array([sum(map(len, s)) / len(s) for s in sentences])
    words = [w for s in sentences for w in s]
    n = len(words)
    hard = np.array([(len(s) >= 22) and sum(len(w) >= 9 for w in s) >= 0.25 * len(s) for s in sentences], float)
    easy = np.array([len(s) <= 11 and sum(map(len, s)) / len(s) < 4.6 for s in sentences], float)
    return [
        float(weights.mean()), float(np.median(weights)), float(np.median(letters)), sum(len(w) >= 7 for w in words) / n, sum(len(w) >= 11 for w in words) / n,
        sum(len(w) <= 4 for w in words) / n, sum(max(1, len(_VOWELS.findall(w))) for w in words) / n, prose.count(",") / n, sum(w in _SUBORDINATE for w in words) / n,
        float(easy.mean()), float((1 - easy - hard).mean()), float(hard.mean()), sum(w in ("you", "your", "i", "we") for w in words) / n,
    ]


class Ranker:
    """Linear pairwise ranker with isotonic calibration; without graded documents every document gets the middle level."""

    def __init__(self, rows: list[list[float]], levels: list[float]):
        x, y = np.array(rows, float).reshape(-1, len(FEATURES)), np.array(levels, float)
        self.usable = len(np.unique(y)) > 1
        if not self.usable:
            self.constant = int(round(y[0])) if len(y) else 2
            return
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = (x - self.centre) / self.scale
        rng = np.random.default_rng(11)
        i = np.repeat(np.arange(len(y)), PAIRS_EACH)
        j = rng.integers(0, len(y), len(i))
        keep = y[i] != y[j]
        i, j = i[keep], j[keep]
        difference = (z[i] - z[j]) * np.sign(y[i] - y[j])[:, None]
        w = np.zeros(z.shape[1])
        for _ in range(40):  # Newton steps of ridge-penalised logistic loss on the differences
            p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
            gradient = difference.T @ p / len(p) - 0.01 * w
            hessian = (difference * (p * (1 - p))[:, None]).T @ difference / len(p) + 0.01 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        score = z @ w
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        for k in order:  # pool adjacent violators
            blocks.append([y[k], 1, score[k]])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b = blocks.pop()
                a = blocks[-1]
                blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], b[2]]
        self.ends, self.means = np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])

    def level(self, rows: list[list[float]]) -> list[int]:
        if not self.usable:
            return [self.constant] * len(rows)
        score = (np.array(rows, float).reshape(-1, len(FEATURES)) - self.centre) / self.scale @ self.weights
        left = np.searchsorted(self.ends, score)
        return np.clip(np.floor(self.means[np.minimum(left, len(self.means) - 1)] + 0.5), LEVELS[0], LEVELS[-1]).astype(int).tolist()


def graded(spark: SparkSession, directory: str) -> DataFrame:
    """``(doc_id, level)``: the mean of each rater's own mean; open ratings and levels outside the scale do not count."""
    labels = table(spark, directory, "reading_labels").filter(F.col("reading_level").between(LEVELS[0], LEVELS[-1]))
    own = labels.groupBy("doc_id", "rater").agg(F.avg("reading_level").alias("own"))
    return own.groupBy("doc_id").agg(F.round(F.avg("own")).alias("level"))


def fit(spark: SparkSession, directory: str) -> Ranker:
    sample = graded(spark, directory).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    documents = table(spark, directory, "documents").select("doc_id", "text").filter("text is not null")
    rows = documents.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def per_slice(columns):
        for level, text in zip(columns["level"], columns["text"]):
            prose = english_prose(text)
            if prose is not None:
                yield features(prose), level

    found = scan(rows.select("level", "text"), per_slice, "x array<double>, y double").collect()
    return Ranker([r.x for r in found], [r.y for r in found])


def levels(spark: SparkSession, directory: str) -> DataFrame:
    """``p10_found(doc_id, reading_level)``; null, empty, blank, non-English texts and source excerpts have no row, repeated rows count once."""
    model = spark.sparkContext.broadcast(fit(spark, directory))

    def per_slice(columns):
        own = [(d, english_prose(t)) for d, t in zip(columns["doc_id"], columns["text"])]
        own = [(d, p) for d, p in own if p is not None]
        if own:
            yield from zip([d for d, _ in own], model.value.level([features(p) for _, p in own]))

    documents = table(spark, directory, "documents").select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return scan(documents, per_slice, "doc_id bigint, reading_level bigint").dropDuplicates(["doc_id"])
