"""Byte-level BPE by monoid tree reduction.

``encode`` splits a text in halves down to leaves of a few thousand
characters, encodes the leaves, and joins neighbours up the tree.  A join
re-encodes a window around the seam: it grows on both sides until it starts
and ends at a place where the pattern's matches must break whatever stands
further out (a white-space character after a non-white one: no alternative
of the pattern has white space behind another character).  Tokens outside
the window then cannot change, so the join is exact.  ``decode`` joins the
bytes of halves up the tree in the same way.

Both work row by row inside Spark's tasks: no shuffle, memory bounded by one
Arrow batch.  Defined results: a NULL text encodes as no tokens, NULL ids
decode as no bytes; every row is kept, rows that repeat included; all other
columns are left aside (the result has only the id column and its own).
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .registry import load, query

LEAF_CHARS = 4096
LEAF_TOKENS = 4096
FIRST_WINDOW = 64
# White space that every Unicode version calls so, after what none calls so.
BREAK = re.compile("(?<=[^\\s᠎])[ \n]")


class TreeCodec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS,
                 leaf_tokens: int = LEAF_TOKENS, window: int = FIRST_WINDOW):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks,
                                     special_tokens={})
        self.leaf_chars, self.leaf_tokens, self.window = leaf_chars, leaf_tokens, window

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf_chars:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._encode(text, lo, mid), self._encode(text, mid, hi)
        start, end = self._stable_window(text, lo, mid, hi)
        old_left = len(self._leaf(text[start:mid]))
        old_right = len(self._leaf(text[mid:end]))
        return np.concatenate([left[:len(left) - old_left], self._leaf(text[start:end]),
                               right[old_right:]])

    def _stable_window(self, text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
        """The smallest grown window around ``mid`` whose ends are certain breaks."""
        start = end = None
        size = self.window
        while start is None:
            at = max(lo, mid - size)
            found = BREAK.search(text, at + 1, mid) if at > lo else None
            start = lo if at == lo else found.start() if found else None
            size *= 2
        size = self.window
        while end is None:
            at = min(hi, mid + size)
            found = BREAK.search(text, mid + 1, at)
            # the character before the break has to stand in the right half too
            end = found.start() if found else hi if at == hi else None
            size *= 2
        return start, end

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf_tokens:
            return self.bpe.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def _codec(ranks_path: str, pattern: str) -> TreeCodec:
    return TreeCodec(ranks_path, pattern)  # one for each worker process


def _encoded(batches, codec: TreeCodec):
    """(k, text) to (k, v): the packed ids."""
    for b in slices(batches, 1):
        ids = [codec.encode(t or "").tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["k", "v"])


def _decoded(batches, codec: TreeCodec):
    """(k, v) to (k, v, w): the bytes of the packed ids."""
    for b in slices(batches, 1):
        out = [codec.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(out, pa.binary())], names=["k", "v", "w"])


def _packed(src: DataFrame, *columns: str) -> T.StructType:
    return T.StructType([T.StructField("k", src.schema["k"].dataType),
                         *[T.StructField(c, T.BinaryType()) for c in columns]])


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``ids_col``: the token ids as little-endian unsigned
    32-bit integers in one binary value (``unpack_ids`` gives an array)."""
    src = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("v"))
    return src.mapInArrow(lambda batches: _encoded(batches, _codec(ranks_path, pattern)),
                          _packed(src, "v")).toDF(id_col, ids_col)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encode``'s rows with the decoded bytes as a further column."""
    src = df.select(F.col(id_col).alias("k"), F.col(ids_col).alias("v"))
    return src.mapInArrow(lambda batches: _decoded(batches, _codec(ranks_path, pattern)),
                          _packed(src, "v", "w")).toDF(id_col, ids_col, bytes_col)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``decode`` of ``encode`` in one Python step: a task holds one worker
    with the rank tables instead of two that pass the ids on."""
    src = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("v"))

    def run(batches):
        codec = _codec(ranks_path, pattern)
        return _decoded(_encoded(batches, codec), codec)

    return src.mapInArrow(run, _packed(src, "v", "w")).toDF(id_col, ids_col, bytes_col)


def unpack_ids(packed):
    """Column: the array of ids in a packed binary column."""
    n = (F.octet_length(packed) / 4).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def number(i):
        low_first = F.hex(F.substring(packed, i * 4 + 1, 4))
        return F.conv(F.concat(*[F.substring(low_first, k, 2) for k in (7, 5, 3, 1)]), 16, 10)
    return F.transform(at, lambda i: number(i).cast("long"))


def default_ranks() -> tuple[str, str]:
    import public_tokenizers as p
    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    both = encode_decode(docs, ranks_path, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; counts and digests."""
    return digests(load(spark, sf_dir, "documents"), *default_ranks())
