"""Evaluation texts leaking into training text (problem 9).

Each shard of the corpus (a bounded run of documents inside a partition) gets an FM-index over symbols that occur in the test items at all;
every other symbol only separates, and runs too short for a match are left out, which loses none.  All phrases are searched backwards together
through a wavelet matrix, occurrences are located by sampled suffix positions, and overlapping ones merge into removal spans.  Test items are taken
in buckets of bounded text, one pass over the corpus for each, so that a set of any size fits the driver and the workers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.tables import table

#: Units of a phrase: words, and characters for Chinese; symbols of a shard; distance of sampled suffix positions; characters of the items of a bucket.
WORDS, CHARACTERS, SHARD, SAMPLED, BUCKET = 13, 26, 400_000, 8, 4_000_000
_WORD = re.compile(r"[^\W_]+")
_UNIT = re.compile(r"[^\W_]")
_HAN = re.compile("[㐀-鿿]")


class FmIndex:
    """Suffix order, wavelet matrix of the BWT and sampled positions of one symbol sequence (0 separates)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        n = len(symbols)
        order = _suffix_order(symbols)
        self.n = n
        bwt = symbols[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.ranks, self.zeros, self.levels = [], [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            ones = ((level >> b) & 1).astype(bool)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int64)]))
            self.zeros.append(n - int(self.ranks[-1][-1]))
            self.levels.append(ones)
            level = np.concatenate([level[~ones], level[ones]])
        self.sampled = np.where(order % SAMPLED == 0, order, -1)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position of the BWT."""
        low = np.zeros_like(at)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            r_at, r_low = self.ranks[k][at], self.ranks[k][low]
            at = np.where(one, self.zeros[k] + r_at, at - r_at)
            low = np.where(one, self.zeros[k] + r_low, low - r_low)
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.bits):
            one = self.levels[k][at]
            out = out * 2 + one
            at = np.where(one, self.zeros[k] + self.ranks[k][at], at - self.ranks[k][at])
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(phrase, low, high)`` of the phrases that occur."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column]
            low, high = self.starts[symbol] + self.rank(symbol, low), self.starts[symbol] + self.rank(symbol, high)
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-order rows."""
        out, steps = np.full(len(rows), -1, np.int64), 0
        live, at = np.arange(len(rows)), rows
        while len(live):
            position = self.sampled[at]
            done = position >= 0
            out[live[done]] = position[done] + steps
            live, at = live[~done], at[~done]
            symbol = self.symbol(at)
            at = self.starts[symbol] + self.rank(symbol, at)
            steps += 1
        return out % self.n


def _suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of the rotations by prefix doubling."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = fresh
        k *= 2
        if rank.max() == n - 1 or k >= n:
            return order


class Phrases:
    """Test items as phrases over their own alphabet, each with the items it comes from."""

    def __init__(self, items: list[tuple[int, list[str]]], size: int):
        self.size = size
        self.alphabet: dict[str, int] = {}
        rows, owners, self.least_han = [], [], 0
        for item, units in items:
            if len(units) < size:
                continue
            coded = np.fromiter((self.alphabet.setdefault(u, len(self.alphabet) + 1) for u in units), np.int32, len(units))
            rows.append(np.lib.stride_tricks.sliding_window_view(coded, size))
            owners.append(np.full(len(units) - size + 1, item, np.int64))
        if not rows:
            self.matrix, self.owner, self.first = np.empty((0, size), np.int32), np.empty(0, np.int64), np.zeros(1, np.int64)
            return
        every, owner = np.concatenate(rows), np.concatenate(owners)
        self.matrix, phrase = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([phrase.reshape(-1).astype(np.int64), owner], axis=1), axis=0)
        self.owner = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.matrix) + 1))
        han = np.array([False, *map(bool, map(_HAN.match, self.alphabet))])
        self.least_han = int(han[self.matrix].sum(axis=1).min())

    def owners(self, phrase: int) -> list[int]:
        """Items that hold a phrase."""
        return self.owner[self.first[phrase] : self.first[phrase + 1]].tolist()

    def coded(self, units: list[str]) -> np.ndarray:
        """Symbols of a document with runs too short for a phrase cut out; 0 separates."""
        symbols = np.fromiter(map(self.alphabet.get, units, _zeros()), np.int64, len(units))
        breaks = np.nonzero(symbols == 0)[0]
        if not len(breaks):
            return symbols
        edges = np.concatenate([[-1], breaks, [len(symbols)]])
        keep = np.zeros(len(symbols), bool)
        for k in np.nonzero(np.diff(edges) > self.size)[0]:
            keep[edges[k] + 1 : edges[k + 1]] = True
        return np.where(keep, symbols, 0)


def _zeros():
    while True:
        yield 0


def _matches(phrases: Phrases, shard: list[tuple[int, np.ndarray]]):
    """``(doc_id, item_id, first, last)`` of each occurrence in a shard, positions counted in units of the document."""
    if not len(phrases.matrix) or not shard:
        return
    starts, parts, at = [], [], 0
    for _, symbols in shard:
        starts.append(at)
        parts += [symbols, np.zeros(1, np.int64)]
        at += len(symbols) + 1
    index = FmIndex(np.concatenate(parts), len(phrases.alphabet) + 1)
    phrase, low, high = index.search(phrases.matrix.astype(np.int64))
    if not len(phrase):
        return
    counts = high - low
    rows = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    positions = index.locate(rows)
    documents = np.searchsorted(starts, positions, side="right") - 1
    for p, d, x in zip(np.repeat(phrase, counts).tolist(), documents.tolist(), positions.tolist()):
        for item in phrases.owners(p):
            yield shard[d][0], item, x - starts[d], x - starts[d] + phrases.size


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _characters(text: str) -> list[str]:
    return _UNIT.findall(text.lower())


_SPANS = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("item_id", T.LongType()), ("unit", T.StringType()), ("first", T.LongType()), ("last", T.LongType()))]
)


def _search(shared):
    """One pass over the corpus for the phrases of a bucket."""

    def run(batches):
        kinds = tuple(zip(("word", "character"), shared.value, (_words, _characters)))
        shards: dict[str, list] = {k: [] for k, _, _ in kinds}
        sizes = dict.fromkeys(shards, 0)

        def emit(kind, phrases):
            spans: dict[tuple[int, int], list[list[int]]] = {}
            for doc, item, a, b in sorted(set(_matches(phrases, shards[kind]))):
                own = spans.setdefault((doc, item), [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
            shards[kind], sizes[kind] = [], 0
            out = [(d, i, kind, a, b) for (d, i), own in spans.items() for a, b in own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=_SPANS.names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for kind, phrases, units in kinds:
                        if not len(phrases.matrix) or (phrases.least_han and len(_HAN.findall(text)) < phrases.least_han):
                            continue
                        symbols = phrases.coded(units(text))
                        if symbols.any():
                            shards[kind].append((doc, symbols))
                            sizes[kind] += len(symbols) + 1
                            if sizes[kind] >= SHARD:
                                yield from emit(kind, phrases)
        for kind, phrases, _ in kinds:
            yield from emit(kind, phrases)

    return run


def _bucket(spark: SparkSession, items: DataFrame, bucket: int, buckets: int):
    """The phrases of a bucket of items, sent to the workers."""
    rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(buckets)) == bucket).collect()
    by_word = Phrases([(r.item_id, _words(r.text)) for r in rows if (r.lang or "").lower() != "zh"], WORDS)
    by_character = Phrases([(r.item_id, _characters(r.text)) for r in rows if (r.lang or "").lower() == "zh"], CHARACTERS)
    return spark.sparkContext.broadcast((by_word, by_character))


def leaks(spark: SparkSession, directory: str) -> DataFrame:
    """``(doc_id, item_id, unit, first, last)``: merged removal spans of each item in each document, in words or (Chinese items) characters.

    Null and empty texts hold nothing, items shorter than a phrase cannot leak, repeated rows give their spans once.
    """
    items = table(spark, directory, "benchmark").select("item_id", "text", "lang").filter("item_id is not null and text is not null").distinct()
    characters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-characters // BUCKET))
    documents = table(spark, directory, "documents").select("doc_id", "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    out = None
    for bucket in range(buckets):
        found_in = documents.mapInArrow(_search(_bucket(spark, items, bucket, buckets)), _SPANS)
        out = found_in if out is None else out.unionByName(found_in)
    return out.distinct()


def found(spark: SparkSession, directory: str) -> DataFrame:
    """``p9_found(doc_id, item_id)``."""
    return leaks(spark, directory).select("doc_id", "item_id").distinct()
