"""Encoding of the whole corpus with a public byte-level BPE (problem 8).

Within a piece of the splitting pattern, the last token of every prefix is unique.  An automaton over the vocabulary reports the tokens that
end at each position; a candidate is the last token when it spans the prefix or is compatible with the last token before it.  Back-pointers
then give the ids.  Pieces and pairs are remembered per worker.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import checkpointed
from factloom.sources.tables import table

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public splitting pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 1_000_000


class ByteBpe:
    """Encoder by prefix dynamic programming."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.pieces: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Tokens by merging the pair of lowest rank again and again: the definition that pair compatibility refers to."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(x + y, 1 << 30), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, first: int, second: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together."""
        known = self.pairs.get((first, second))
        if known is None:
            known = self.merged(self.bytes_of[first] + self.bytes_of[second]) == [first, second]
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            self.pairs[first, second] = known
        return known

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[tuple[int, int]] = [(-1, 0)] * (len(data) + 1)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(len(data) + 1)]
        for end, match in self.automaton.iter(data.decode("latin-1")):
            matches[end + 1].append(match)
        for end in range(1, len(data) + 1):
            for token, size in sorted(matches[end], key=lambda m: -m[1]):
                start = end - size
                if start == 0 or (last[start][0] >= 0 and self.compatible(last[start][0], token)):
                    last[end] = (token, start)
                    break
        out, end = [], len(data)
        while end:
            token, end = last[end]
            out.append(token)
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.pieces
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(known) > REMEMBERED:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


#: Repeated document ids up to which they are sent to the scan instead of being joined by an exchange.
REPEATED_IDS = 1_000_000


def ids(spark: SparkSession, directory: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``p8_ids(doc_id, ids)``; a null or empty text has no ids, strings like special tokens are ordinary text, rows without a doc_id are no documents.

    Texts are encoded where they are read.  Only the ids are counted to find documents that come more than once; of these the least encoding stands.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    path = f"{tokenizers}/byte_bpe_50k.tiktoken"

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                encoded = [bpe.encode(t) if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(encoded, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    documents = table(spark, directory, "documents").select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    repeated = checkpointed(documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    count = repeated.count()
    if not count:
        return documents.mapInArrow(run, schema)
    side = F.broadcast(repeated) if count <= REPEATED_IDS else repeated
    once = documents.join(side, "doc_id", "left_anti").mapInArrow(run, schema)
    several = documents.join(side, "doc_id", "left_semi").mapInArrow(run, schema)
    return once.unionByName(several.groupBy("doc_id").agg(F.min("ids").alias("ids")))
