"""Token counts by a two-tier lookup on the map side.

The piece model never joins characters across a space that follows another
character, nor across a line feed (checked on its vocabulary), so a text's
count is the sum over its pre-tokens: runs of spaces with the word behind
them.  Lengths of frequent pre-tokens come from one small broadcast table;
the others are encoded once per worker and remembered in a bounded cache.

The table is made from the whole corpus without shuffling pre-tokens: every
task keeps a bounded summary of its own (lossy counting) and hands on its
most frequent ones.  What the table holds changes only the speed.

Defined results: NULL or empty text has no tokens; every row is kept.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .registry import load, query

TABLE_SIZE = 16_384       # entries broadcast
TASK_TOP = 4_096          # entries handed on by a task
TASK_KEEP = 200_000       # entries a task counts at once
CACHE_SIZE = 500_000      # entries a worker remembers
LONGEST_KEPT = 64         # characters of a remembered pre-token
RUNS = re.compile(" *[^ ]+| +")


class PieceModel:
    """Lengths in tokens of pre-tokens that carry their leading spaces."""

    def __init__(self, model_path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for i in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(i)
            if "\n" in piece or re.search("[^▁]▁", piece):
                raise ValueError(f"{model_path} joins pre-tokens: {piece!r}")
        self.lead = len(self.sp.encode("\n"))

    def length(self, pre_token: str) -> int:
        # behind a line feed the model puts no space of its own before the text
        return len(self.sp.encode("\n" + pre_token)) - self.lead


class Lengths(dict):
    """Pre-token (without its single leading space) -> length."""

    def __init__(self, model: PieceModel, frequent: dict[str, int], cache_size: int = CACHE_SIZE):
        super().__init__(frequent)
        self.model, self.frequent, self.cache_size = model, frequent, cache_size

    def __missing__(self, word: str) -> int:
        n = self.model.length(" " + word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.cache_size + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n

    def run(self, pre_token: str) -> int:
        """Length of a pre-token with no or several leading spaces."""
        key = "\n" + pre_token  # no word has a line feed
        n = self.get(key)
        if n is None:
            n = self.model.length(pre_token)
            if len(key) <= LONGEST_KEPT and len(self) < self.cache_size + len(self.frequent):
                self[key] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        total = 0
        lines = (" " + text.replace("▁", " ")).split("\n")
        total = len(lines) - 1
        for line in lines:
            if line and "  " not in line and line[-1] != " ":
                words = line.split(" ")
                if words[0]:
                    total += self.run(words[0])
                total += sum(map(self.__getitem__, words[1:]))
            elif line:
                for x in RUNS.findall(line):
                    if x[0] == " " and len(x) > 1 and x[1] != " ":
                        total += self[x[1:]]
                    else:
                        total += self.run(x)
        return total


@lru_cache(maxsize=2)
def _model(model_path: str) -> PieceModel:
    return PieceModel(model_path)


def frequent_lengths(df: DataFrame, model_path: str, text_col: str = "text",
                     table_size: int = TABLE_SIZE, task_top: int = TASK_TOP,
                     task_keep: int = TASK_KEEP) -> dict[str, int]:
    """The most frequent words of the column and their lengths, at most
    ``table_size``.  One pass; only ``task_top`` rows leave a task."""
    def summary(batches):
        counts, floor = Counter(), 0
        for b in slices(batches, 0):
            for t in b.column(0).to_pylist():
                counts.update((t or "").replace("\n", " ").split(" "))
                while len(counts) > task_keep:  # lossy counting: the rare ones go
                    floor += 1
                    counts = Counter({w: n for w, n in counts.items() if n > floor})
        counts.pop("", None)
        top = [x for x in counts.most_common(task_top) if len(x[0]) <= LONGEST_KEPT]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()),
                                          pa.array([n for _, n in top], pa.int64())],
                                         names=["w", "n"])

    parts = df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(
        summary, "w string, n long")
    top = (parts.groupBy("w").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "w").limit(table_size).collect())
    model = _model(model_path)
    return {r.w: model.length(" " + r.w) for r in top}


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 table_size: int = TABLE_SIZE) -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of every row."""
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(
        frequent_lengths(df, model_path, text_col, table_size))
    src = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("v"))

    def run(batches):
        lengths = Lengths(_model(model_path), table.value)
        for b in slices(batches, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array([lengths.count(t) for t in texts], pa.int64())],
                names=["k", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("k", src.schema["k"].dataType),
                           T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    return src.mapInArrow(run, schema).withColumnRenamed("k", id_col)


def default_model() -> str:
    import public_tokenizers as p
    return p.path("piece_bpe_32k.model")


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they pass 4,096."""
    counts = count_tokens(load(spark, sf_dir, "documents"), default_model())
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)
