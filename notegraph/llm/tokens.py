"""Token counts by the whole-token shortcut.

Every string of the vocabulary that is valid UTF-8 encodes alone as itself: one token (``tests/llm`` proves it against
the library for the whole vocabulary). So a pre-token that is in the table counts 1 at once, and only the others are
merged, once each while a bounded memory holds them. The merge runs on the vocabulary's ranks; where all vocabulary
strings encode alone as one token, merging by rank of the joined string and merging by the list of pairs are the same.

Defined results: null text is empty: 0 bytes, 0 tokens; a special token's string inside a text is that special token, as
is the library's default; texts of any length are counted whole; repeated rows are counted each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.common import arrow_of, slim

LIMIT = 512
HELD = 400_000
#: The byte-level pre-token rule, with possessive repeats where no backtracking can succeed.
PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    back = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}
    special = {t["content"] for t in model["added_tokens"]}
    return {bytes(back[c] for c in s): i for s, i in model["model"]["vocab"].items() if s not in special}


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary as an encoder; special strings in a text become their special token."""
    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("own", pat_str=PIECE, mergeable_ranks=ranks(path), special_tokens=special)


class PieceCounts(dict):
    """Tokens by pre-token. ``whole``: the vocabulary's strings, each 1; others are merged when first met."""

    def __init__(self, path: str, held: int = HELD):
        super().__init__()
        self.path, self.held = path, held
        self.enc = encoder(path)
        self.merge = self.enc._core_bpe.encode_single_piece
        self.special = sorted(self.enc.special_tokens_set)
        self.whole = {}
        for b in ranks(path):
            try:
                self.whole[b.decode()] = 1
            except UnicodeDecodeError:
                continue
        self.update(self.whole)
        self.piece = regex.compile(PIECE)

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(piece.encode()))
        self[piece] = n
        return n

    def part(self, text: str) -> int:
        if len(self) > self.held + len(self.whole):
            self.clear()
            self.update(self.whole)
        return sum(map(self.__getitem__, self.piece.findall(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts, n = [text], 0
        for s in self.special:
            if s in text:
                cut = [x.split(s) for x in parts]
                n += sum(len(x) - 1 for x in cut)
                parts = [y for x in cut for y in x]
        return n + sum(map(self.part, parts))


@functools.cache
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row. No shuffle: one pass of Arrow batches."""
    path = path or tokenizer_path()
    ddl = "doc_id bigint, n_bytes bigint, n_tokens bigint"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(path)
        for b in batches:
            n = [counts.count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], schema=schema)

    rows = slim(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "text",
    )
    return rows.mapInArrow(run, ddl).withColumn("over_limit", F.col("n_tokens") > limit)


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return token_counts(docs)
