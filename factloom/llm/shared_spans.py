"""Long exact spans shared between files (problem 7): seed and extend.

Anchors are winnowed hashes of SEED bytes, dense enough that any common span of MINIMUM bytes holds one at the same place of the span.  An anchor
that several contents have is extended both ways: every MINIMUM-byte window around it whose bytes several contents have is a shared window, and the
union of a file's shared windows are its maximal repeats.  Where all contents agree on one side of an anchor the outermost window of that side links
them all; all windows are looked at only where they disagree, so work follows the edges of spans, not the pairs.  Exact copies are one class.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, scan
from factloom.sources.tables import table

#: Least length of a shared span; bytes of a seed.  Every MINIMUM bytes hold MINIMUM - SEED + 1 seeds, the window of the winnowing.
MINIMUM, SEED = 400, 200
#: Holders of one span that a task pairs with as many others; a larger group is split into blocks of this size.
BLOCK = 2000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTES = tuple(np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (7, 8))


def rolling(data: bytes, size: int, variant: int = 0) -> np.ndarray:
    """Mixed 64-bit hash of every ``size`` consecutive bytes; two variants are independent of each other."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    base = _BASES[variant] | 1
    values = _BYTES[variant][np.frombuffer(data, np.uint8)]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(values), base, np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers)])
        hashes = (sums[size:] - sums[:-size]) * np.cumprod(np.full(len(values) - size + 1, pow(base, -1, 1 << 64), np.uint64))
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
    return hashes


def _window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones: prefix minima of one block and suffix minima of the block before cover every window."""
    n = len(hashes)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = hashes
    blocks = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def anchors(data: bytes, minimum: int = MINIMUM, seed: int = SEED) -> np.ndarray:
    """Distinct minimum hashes of the windows of ``minimum - seed + 1`` seeds."""
    if len(data) < minimum:
        return np.empty(0, np.int64)
    return np.unique(_window_minima(rolling(data, seed), minimum - seed + 1)).view(np.int64)


def placed_anchors(data: bytes, minimum: int = MINIMUM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, positions)`` of all seeds that are the least of some window; every equal one counts, so that the choice depends on the window alone."""
    if len(data) < minimum:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, width = rolling(data, seed), minimum - seed + 1
    least = _window_minima(hashes, width)
    # a seed is chosen when it equals the greatest of the minima of the windows it lies in
    n = len(hashes)
    around = np.zeros(n + width - 1, np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    greatest = ~_window_minima(~around, width)
    positions = np.nonzero(hashes == greatest[:n])[0]
    return hashes[positions], positions


def _contexts(data: bytes, hashes: np.ndarray, positions: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that reach as far as the extension of each anchor does to the left and right; a value of the file's own where the file ends before."""
    reach = MINIMUM - SEED
    wide = rolling(data, MINIMUM)
    alone = np.uint64(own) ^ hashes
    left = np.where(positions >= reach, wide[np.clip(positions - reach, 0, len(wide) - 1)], alone)
    right = np.where(positions < len(wide), wide[np.clip(positions, 0, len(wide) - 1)], alone)
    return left, right


def windows(data: bytes, edges: dict[int, bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, second key, first, last)`` of the windows of MINIMUM bytes around the given anchors, starts of equal windows that overlap as one run.

    ``edges`` tells of each anchor whether all windows that hold its seed count, or the outermost two.
    """
    reach, n = MINIMUM - SEED, len(data) - MINIMUM + 1
    hashes, positions = placed_anchors(data)
    known = np.array(sorted(edges), np.int64)
    flags = np.array([edges[k] for k in known.tolist()], bool)
    at = np.searchsorted(known, hashes.view(np.int64))
    at = np.minimum(at, max(0, len(known) - 1))
    held = known[at] == hashes.view(np.int64) if len(known) else np.zeros(len(hashes), bool)
    edge, plain = positions[held & flags[at]], positions[held & ~flags[at]]
    change = np.zeros(n + MINIMUM + 1, np.int64)
    np.add.at(change, np.maximum(edge - reach, 0), 1)
    np.add.at(change, edge + 1, -1)
    taken = np.cumsum(change)[:n] > 0
    for starts in (plain, plain - reach):
        taken[starts[(starts >= 0) & (starts < n)]] = True
    starts = np.nonzero(taken)[0]
    key, second = rolling(data, MINIMUM)[starts], rolling(data, MINIMUM, 1)[starts]
    order = np.lexsort((starts, second, key))
    key, second, starts = key[order], second[order], starts[order]
    if not len(starts):
        return key.view(np.int64), second.view(np.int64), starts, starts
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (second[1:] != second[:-1]) | (starts[1:] - starts[:-1] > MINIMUM)])
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    return key[first].view(np.int64), second[first].view(np.int64), starts[first], starts[last]


def _files(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "source_documents").select("file_id", "content").filter(F.col("file_id").isNotNull() & (F.length("content") >= MINIMUM))


def _anchored(spark: SparkSession, directory: str) -> DataFrame:
    """``(file_id, hash, seeds, lefts, rights)`` of each delivery that can share anything: one pass over the contents, written once for all that follows."""

    def seeds(columns):
        import hashlib

        for file_id, content in zip(columns["file_id"], columns["content"]):
            digest = hashlib.sha256(content).digest()[:16]
            hashes, positions = placed_anchors(content)
            rows = np.stack([hashes, *_contexts(content, hashes, positions, int.from_bytes(digest[:8], "little"))])
            if len(np.unique(hashes)) < len(hashes):
                rows = np.unique(rows, axis=1)
            yield file_id, digest, *(x.view(np.int64).tolist() for x in rows)

    return checkpointed(scan(_files(spark, directory), seeds, "file_id bigint, hash binary, seeds array<bigint>, lefts array<bigint>, rights array<bigint>"))


def _classes(anchored: DataFrame) -> DataFrame:
    """``(file_id, class_id)``: files of equal content share the least file id as their class."""
    once = anchored.select("file_id", "hash").dropDuplicates(["file_id"])
    least = once.groupBy("hash").agg(F.min("file_id").alias("class_id"))
    return once.join(least, "hash").select("file_id", "class_id")


def _windows(spark: SparkSession, directory: str, anchored: DataFrame, classes: DataFrame, extents: bool) -> DataFrame:
    """``(key, second, file_id, first, last)``: windows of class representatives around anchors that several contents have.

    Contents that agree on either side of an anchor are linked by the window of that side; all windows are needed where they agree on neither, and
    for the ``extents`` of the spans wherever they disagree at all.
    """
    zipped = F.explode(F.arrays_zip("seeds", "lefts", "rights")).alias("s")
    seeds = anchored.select("file_id", F.xxhash64("hash").alias("kind"), zipped).select("file_id", "kind", F.col("s.seeds").alias("seed"), F.col("s.lefts").alias("left"), F.col("s.rights").alias("right"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("kind", "left", "right") for f in (F.min, F.max)]
    left, right = (F.col(f"min_{c}") != F.col(f"max_{c}") for c in ("left", "right"))
    shared = seeds.groupBy("seed").agg(*ends).filter("min_kind <> max_kind").select("seed", (left | right if extents else left & right).alias("edge"))
    own = seeds.select("file_id", "seed").join(shared, "seed").groupBy("file_id").agg(F.collect_set(F.struct("seed", "edge")).alias("held"))
    representatives = classes.filter("file_id = class_id").select("file_id")
    contents = _files(spark, directory).join(own.join(representatives, "file_id", "left_semi"), "file_id").dropDuplicates(["file_id"])

    def extend(columns):
        for file_id, content, held in zip(columns["file_id"], columns["content"], columns["held"]):
            for row in zip(*(x.tolist() for x in windows(content, {h["seed"]: h["edge"] for h in held}))):
                yield row[0], row[1], file_id, row[2], row[3]

    return checkpointed(scan(contents.select("file_id", "content", "held"), extend, "key bigint, second bigint, file_id bigint, first bigint, last bigint"))


def _pairs_within(members: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b)``, ``a < b``, of the ``file_id`` of each group; a group of ``n`` above BLOCK is split into blocks that meet pairwise."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("file_id"), blocks).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        *keys, "file_id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*keys, "low", "high")]
    apart = (F.col("l.low") == F.col("l.high")) | (F.col("l.block") != F.col("r.block"))
    condition = (F.col("l.file_id") < F.col("r.file_id")) & apart
    for c in on:
        condition = condition & c
    return met.alias("l").join(met.alias("r"), condition).select(F.col("l.file_id").alias("a"), F.col("r.file_id").alias("b")).distinct()


def _held_windows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``(key, second, file_id)`` of all windows, and the windows of several files with their size, one for each set of files."""
    members = found.select("key", "second", "file_id").distinct()
    groups = members.groupBy("key", "second").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("file_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "file_id")).alias("y")
    ).filter("n > 1")
    return members, groups.groupBy("n", "x", "y").agg(F.min(F.struct("key", "second")).alias("one")).select("one.key", "one.second", "n")


def _linked(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Classes and distinct pairs ``(a, b)`` of class representatives that share a span."""
    anchored = _anchored(spark, directory)
    classes = checkpointed(_classes(anchored))
    members, groups = _held_windows(_windows(spark, directory, anchored, classes, extents=False))
    return classes, _pairs_within(members, ["key", "second"], groups)


def found(spark: SparkSession, directory: str) -> DataFrame:
    """``p7_found(file_id_a, file_id_b)``; null, empty and short contents share nothing, repeated deliveries count once.

    Every pair is listed, those of exact copies too, so the result of a group that shares a span is quadratic in it; :func:`links` is not.
    """
    classes, pairs = _linked(spark, directory)
    left, right = classes.select(F.col("file_id").alias("x"), F.col("class_id").alias("a")), classes.select(F.col("file_id").alias("y"), F.col("class_id").alias("b"))
    between = pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("file_id_a"), F.greatest("x", "y").alias("file_id_b"))
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    within = _pairs_within(classes, ["class_id"], sizes).select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"))
    return between.unionByName(within)


def links(spark: SparkSession, directory: str) -> DataFrame:
    """``p7_links(file_id, class_id, copies, links)``: the class of each file that can share a span, its files, and the files of other classes it shares one with."""
    classes, pairs = _linked(spark, directory)
    copies = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(copies.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("copies").alias("links"))
    return classes.join(copies, "class_id").join(counted, "class_id", "left").select("file_id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def shares(spark: SparkSession, directory: str) -> DataFrame:
    """``(file_id, n_bytes, shared_bytes, share)``: how much of each file lies in spans that another file has too; empty files share 0.0."""
    anchored = _anchored(spark, directory)
    classes = checkpointed(_classes(anchored))
    spans = _windows(spark, directory, anchored, classes, extents=True)
    shared = spans.groupBy("key", "second").agg(F.min("file_id").alias("low"), F.max("file_id").alias("high")).filter("low <> high").select("key", "second")
    ends = spans.join(shared, ["key", "second"], "left_semi").select(F.col("file_id").alias("class_id"), F.col("first").alias("s"), (F.col("last") + MINIMUM).alias("e"))
    order = Window.partitionBy("class_id").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = ends.withColumn("part", F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(reach, F.lit(0)))))
    covered = new.groupBy("class_id").agg(F.sum("part").alias("part"))
    copies = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("files"))
    sizes = table(spark, directory, "source_documents").filter("file_id is not null").groupBy("file_id").agg(F.max(F.coalesce(F.length("content"), F.lit(0))).cast("bigint").alias("n_bytes"))
    joined = sizes.join(classes, "file_id", "left").join(copies, "class_id", "left").join(covered, "class_id", "left")
    taken = F.when(F.col("files") > 1, F.col("n_bytes")).otherwise(F.coalesce("part", F.lit(0))).cast("bigint")
    return joined.select("file_id", "n_bytes", taken.alias("shared_bytes"), F.when(F.col("n_bytes") > 0, F.round(taken / F.col("n_bytes"), 6)).otherwise(0.0).alias("share"))
