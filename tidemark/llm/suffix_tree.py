"""Language-model scores by a probabilistic suffix tree.

Symbols are words and one end for each document.  A context is the word or
words before a symbol; the tree retains contexts of different lengths, and a
symbol is scored in the longest suffix of its past that the tree retains:

* the empty context has add-one frequencies of all words;
* words seen ``least`` times or more in training are symbols of their own
  behind a context, all others share one symbol there and are told apart by
  their add-one frequencies.  ``least`` is ``min_count`` at every size of the
  corpus; a caller may have it follow the root of the training tokens' number
  (``root_share`` of it, ``min_count`` or more);
* a context of ``d`` words is tried where the context of its last ``d - 1``
  words is retained and training holds it ``least`` times or more.  It is
  retained where its next symbols diverge from those of that shorter context:
  its count times the Kullback-Leibler divergence is at least ``evidence`` for
  each of its different next symbols (chance alone gives a half);
* a retained context's distribution is smoothed with that of the shorter one,
  which counts as ``mu`` observations.

All counts are of the whole training text and live in Spark tables.
Documents are coded once in blocks of ``BLOCK_BYTES`` of text: a block's own
words, and for every token the number of its word.  For every context length
a block hands out its contexts with the different symbols behind them and
their counts, dealt by context over buckets whose number follows the corpus
(a very frequent context in several parts).  So a word or context counts no
more often than there are blocks, and a bucket's group in one task stands for
about ``BUCKET`` tokens.  The sums of a group answer each of its rows, and the
answers go back to the blocks.  Nothing is broadcast and nothing passes
through the driver but the corpus totals.

Words are compared by their bytes when they are counted, contexts of one and
two words by their symbols' numbers, longer ones (and where numbers pass 32
bits) by 64-bit hashes.  Frequent words get small numbers, and what a block
hands out is in the numbers' order, so that differences can be packed.  A table
goes as soon as nothing reads it any more.  Defined results: NULL or empty text is one end;
documents of unknown membership (NULL) are learnt from; repeated rows are
counted and scored as often as they stand; an empty table gives no rows, and
where nothing is learnt every token has probability 1.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

from .batches import slices
from .links import Scratch, shuffles_end_with_jobs
from .registry import load, query

DEPTH = 2
MIN_COUNT = 8
ROOT_SHARE = 0.0
EVIDENCE = 2.0
MU = 30.0
BLOCK_BYTES = 8 << 20
PART = 1 << 20               # training tokens behind one part of a context
BUCKET = 1 << 20             # tokens of the corpus for each bucket of contexts
WORDS_OF_BUCKET = 1 << 18    # entries of the vocabulary counted in one task's group
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b""                    # no word is empty
UNIT = 2.0 ** -32            # of the sums of logarithms that blocks hand out
ODD = np.uint64(0x9E3779B97F4A7C15)


def words(raw: bytes | None) -> list[bytes]:
    return raw.translate(LOWER).split() if raw else []


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers leave whole planes of zeros."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0xBF58476D1CE4E5B9) ^ (b + ODD)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(31)


def _joined(column, kind=np.int64) -> np.ndarray:
    """The packed numbers of a column, one row after another."""
    return np.concatenate([np.zeros(0, kind), *[_unpack(x, kind) for x in column.to_pylist()]])


def _packs(flat: np.ndarray, cuts) -> pa.Array:
    """Packed rows between the places ``cuts``."""
    return pa.array([_pack(flat[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


def _halves(a: np.ndarray) -> np.ndarray:
    """The upper halves of 64-bit numbers as differences from the last one's."""
    upper = np.diff((a >> np.uint64(32)).astype(np.uint32), prepend=np.uint32(0))
    return upper.astype(np.uint64) << np.uint64(32) | a & np.uint64(0xFFFFFFFF)


def _whole(a: np.ndarray) -> np.ndarray:
    """Back from ``_halves``."""
    upper = np.cumsum((a >> np.uint64(32)).astype(np.uint32), dtype=np.uint32)
    return upper.astype(np.uint64) << np.uint64(32) | a & np.uint64(0xFFFFFFFF)


def _steps(a: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The differences inside runs of these sizes, each from its first number."""
    out, first = np.diff(a, prepend=0), np.cumsum(sizes) - sizes
    out[first] = a[first]
    return out


def _climbed(a: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Back from ``_steps``."""
    total, first = np.cumsum(a), np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - a[first], sizes)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one range after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


class Totals:
    """Corpus totals: training tokens, different ones, the weight of the
    tokens that are no symbols of their own (in units of ``1 / z``), and the
    numbers of buckets of words and of contexts, the tokens of a context's
    part, and the least count of a symbol or context; ``own`` is the most
    symbols of a bucket of words, and ``pairs`` whether two symbols' numbers
    fit into 64 bits."""

    def __init__(self, tokens: int, distinct: int, rare: int, buckets: int = 1, context_buckets: int = 1,
                 part: int = PART, least: int = MIN_COUNT, own: int = 0):
        self.pairs = (own + 1) * buckets < 1 << 32
        self.tokens, self.z, self.rare = tokens, tokens + distinct + 1, rare + 1
        self.buckets, self.context_buckets, self.part, self.least = buckets, context_buckets, part, least


class Replay:
    """One block of documents, scored with the context lengths answered so
    far.  ``count`` and ``symbol`` are of the block's words: how often training
    holds them, and their numbers as symbols (0: none)."""

    def __init__(self, idx, lengths, train, count, symbol, totals: Totals, mu: float):
        self.mu, self.n, self.totals = mu, lengths, totals
        self.starts = np.r_[0, np.cumsum(lengths)[:-1]]
        self.first = np.zeros(len(idx), bool)
        self.first[self.starts] = True
        self.train = np.repeat(train, lengths).astype(np.float64)
        own = symbol > 0
        self.base = int(own.sum()) + 1
        self.number = np.r_[0, np.sort(symbol[own])]        # the corpus's symbol numbers
        self.symbol = np.searchsorted(self.number, symbol)[idx]
        self.known = count[idx]
        self.p0 = (self.known + 1) / totals.z
        self.p = np.where(self.symbol > 0, self.p0, totals.rare / totals.z)
        self.within = np.where(self.symbol > 0, 1.0, (self.known + 1) / totals.rare)
        self.depth = np.zeros(len(idx), np.int64)
        # the gram that ends at a position: event, count, hash
        self.event, self.gram_n, self.whole = self.symbol, self.known, self.symbol > 0
        self.hash, self.words = self.number.astype(np.uint64), 0
        self.kept = np.ones(len(idx), bool)

    def open(self) -> None:
        """Events of the next context length, in the order of their contexts,
        a context's parts and the symbols."""
        valid = np.zeros(len(self.symbol), bool)
        valid[1:] = (self.whole[:-1] & ~self.first[1:] & (self.gram_n[:-1] >= self.totals.least)
                     & self.kept[1:])
        self.at = np.flatnonzero(valid)
        keys = self.event[self.at - 1].astype(np.int64) * self.base + self.symbol[self.at]
        uniq, first, which = np.unique(keys, return_index=True, return_inverse=True)
        n = self.gram_n[self.at[first] - 1]
        context, symbol = uniq // self.base, uniq % self.base
        parts = n // self.totals.part + 1
        part = (self.number[symbol].astype(np.uint64) * ODD >> np.uint64(40)).astype(np.int64) % parts
        # ``uniq`` is in the order of contexts and symbols
        order = np.lexsort((part, context)) if part.any() else np.arange(len(uniq))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.which, first = rank[which], first[order]
        self.context_n, self.next, part = n[order], symbol[order], part[order]
        self.context = self.hash[context[order]]
        self.words, number = self.words + 1, self.number[self.next].astype(np.uint64)
        exact = self.words == 1 and self.totals.pairs
        self.key = self.context << np.uint64(32) | number if exact else _mixed(self.context, number)
        self.in_train = np.bincount(self.which, self.train[self.at], len(uniq)).astype(np.int64)
        self.shorter = self.p[self.at[first]]
        # runs of one context and part, and their order by bucket
        new = np.r_[True, (context[order][1:] != context[order][:-1]) | (part[1:] != part[:-1])]
        self.runs = np.flatnonzero(new[:len(order)])
        self.sizes = np.diff(np.r_[self.runs, len(order)])
        self.parts = parts[order][self.runs]
        self.bucket = (_mixed(self.context[self.runs], part[self.runs].astype(np.uint64))
                       % np.uint64(self.totals.context_buckets)).astype(np.int64)
        self.dealt = np.argsort(self.bucket, kind="stable")

    def close(self, n: np.ndarray, kept: np.ndarray) -> None:
        """``n``: the events' counts; ``kept``: whether their contexts are retained."""
        p = (n + self.mu * self.shorter) / (self.context_n + self.mu)
        mine = kept[self.which]
        self.p[self.at[mine]] = p[self.which][mine]
        self.depth[self.at[mine]] += 1
        size = len(self.symbol)
        self.kept, self.event, self.gram_n, self.whole = (
            np.zeros(size, bool), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool))
        self.kept[self.at] = mine
        self.event[self.at] = self.which
        self.gram_n[self.at] = n[self.which]
        self.whole[self.at] = (self.next > 0)[self.which]
        self.hash = self.key


class _Numbers(dict):
    """A number for each new key, from 0."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


BLOCK = "block long, idx binary, lengths binary, train binary, words binary, counts binary, n_words long, n_tokens long, n_train long"
ANSWER = "b long, level int, part int, e int, v binary, w binary, x binary"
EVENTS = "bucket int, b long, context binary, parts binary, sizes binary, lp binary, symbols binary, n binary"
SUMMED = ("b long, bucket int, e int, v binary, w binary, context long, t double, different long, "
          "total double, lp double")


def _schema(text: str, *more: T.StructField) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(text).fields, *more])


def _code(docs: DataFrame, kind: T.DataType) -> DataFrame:
    """One row for each block of documents; ``docs`` is (k, raw, train)."""
    def code(batches):
        task, made = TaskContext.get().partitionId(), 0
        for b in slices(batches, 1, BLOCK_BYTES):
            vocabulary = _Numbers()
            number = vocabulary.__getitem__
            tokens: list[bytes] = []
            ends = [0]
            for t in b.column(1).to_pylist():
                tokens += words(t)
                tokens.append(END)
                ends.append(len(tokens))
            lengths = np.diff(ends).astype(np.int64)
            idx = np.fromiter(map(number, tokens), np.uint32, len(tokens))
            train = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            n = np.bincount(idx, np.repeat(train, lengths), len(vocabulary)).astype(np.int64)
            # frequent words get small numbers
            order = np.argsort(-np.bincount(idx), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            ws = list(vocabulary)
            blob = zstandard.ZstdCompressor(level=1).compress(b"\n".join([ws[i] for i in order.tolist()]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 24 | made], pa.int64()),
                 *[pa.array([x], pa.binary()) for x in (_pack(rank[idx]), _pack(lengths), _pack(train), blob,
                                                        _pack(n[order]))],
                 pa.array([len(ws)], pa.int64()), pa.array([len(idx)], pa.int64()),
                 pa.array([int(n.sum())], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))],
                names=["block", "idx", "lengths", "train", "words", "counts", "n_words", "n_tokens", "n_train", "k"])
            made += 1

    return docs.mapInArrow(code, _schema(BLOCK, T.StructField("k", T.ArrayType(kind))))


def _words_of(blob: bytes, buckets: int) -> tuple[list[bytes], np.ndarray]:
    """A block's words and their buckets."""
    ws = zstandard.ZstdDecompressor().decompress(blob).split(b"\n")
    return ws, np.fromiter(map(crc32, ws), np.int64, len(ws)) % buckets


def _vocabulary(blocks: DataFrame, min_count: int, root_share: float, part: int, bucket: int, tables: Scratch) -> tuple[DataFrame, Totals]:
    """Answers of level 0, the counts and symbol numbers of the blocks' words,
    and the corpus totals."""
    n_words, n_tokens, n_train = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (
        "n_words", "n_tokens", "n_train")]).first()
    least = max(min_count, math.ceil(root_share * math.sqrt(n_train)))
    buckets = max(1, math.ceil(n_words / WORDS_OF_BUCKET))

    def deal(batches):
        for b in batches:
            for block, blob, counts in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                ws, of = _words_of(blob, buckets)
                n, order = _unpack(counts, np.int64), np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(of[order]) > 0, True])
                at = order.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[order[cuts[:-1]]], pa.int32()),
                     pa.array([block] * (len(cuts) - 1), pa.int64()),
                     pa.array([b"\n".join([ws[i] for i in at[lo:hi]])
                               for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                     _packs(n[order], cuts),
                     pa.array([_pack(np.diff(order[lo:hi], prepend=0))
                               for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                    names=["part", "b", "words", "n", "x"])

    def count(table: pa.Table) -> pa.Table:
        mine = table["part"][0].as_py()
        rows = [x.split(b"\n") for x in table["words"].to_pylist()]
        total = Counter()
        for ws, n in zip(rows, table["n"].to_pylist(), strict=True):
            for w, x in zip(ws, _unpack(n, np.int64).tolist(), strict=True):
                total[w] += x
        # frequent ones first; buckets are alike, so this is nearly the order in the corpus
        own = sorted((w for w, c in total.items() if c >= least), key=lambda w: (-total[w], w))
        number = {w: i for i, w in enumerate(own, 1)}
        counts = [_pack(np.array([total[w] for w in ws], np.int64)) for ws in rows]
        numbers = [_pack(np.array([number.get(w, 0) for w in ws], np.int64)) for ws in rows]
        sums = [sum(total.values()), sum(c > 0 for c in total.values()),
                sum(c + 1 for c in total.values() if 0 < c < least), len(own)]
        n = len(rows)
        return pa.table({"b": pa.array([*table["b"].to_pylist(), None], pa.int64()),
                         "level": pa.array([0] * (n + 1), pa.int32()),
                         "part": pa.array([mine] * (n + 1), pa.int32()),
                         "e": pa.array([0] * (n + 1), pa.int32()),
                         "v": pa.array([*counts, None], pa.binary()), "w": pa.array([*numbers, None], pa.binary()),
                         "x": pa.array([*table["x"].to_pylist(), None], pa.binary()),
                         "sums": pa.array([*[None] * n, sums], pa.list_(pa.int64()))})

    dealt = blocks.select("block", "words", "counts").mapInArrow(
        deal, "part int, b long, words binary, n binary, x binary")
    found = tables.write(dealt.groupBy("part").applyInArrow(
        count, _schema(ANSWER, T.StructField("sums", T.ArrayType(T.LongType())))))
    t = found.filter("sums IS NOT NULL").agg(*[F.coalesce((F.max if i == 3 else F.sum)(F.col("sums")[i]), F.lit(0))
                                               for i in range(4)])
    *sums, own = t.first()
    return (found.filter("b IS NOT NULL").drop("sums"),
            Totals(*sums, buckets, max(1, math.ceil(n_tokens / bucket)), part, least, own))


def _replayed(block: pa.Table, answers: pa.Table, totals: Totals, mu: float, levels: int) -> Replay:
    """The block with the answers of ``levels`` context lengths."""
    level = answers["level"].to_numpy()
    mine = answers.filter(pa.array(level == 0))
    count, symbol = np.zeros((2, block["n_words"][0].as_py()), np.int64)
    for at, v, w, part in zip(*[mine[c].to_pylist() for c in ("x", "v", "w", "part")], strict=True):
        at, w = np.cumsum(_unpack(at, np.int64)), _unpack(w, np.int64)
        count[at], symbol[at] = _unpack(v, np.int64), np.where(w > 0, 1 + (w - 1) * totals.buckets + part, 0)
    r = Replay(*[_unpack(block[c][0].as_py(), t) for c, t in (("idx", np.uint32), ("lengths", np.int64),
                                                              ("train", np.uint8))],
               count, symbol, totals, mu)
    for d in range(1, levels + 1):
        r.open()
        mine = answers.filter(pa.array(level == d))
        whole = mine["e"].to_numpy() < 0
        sums = mine.filter(pa.array(whole)).sort_by("part")
        n, kept = np.zeros(len(r.key), np.int64), np.zeros(len(r.runs), bool)
        n[_ranges(r.runs[r.dealt], r.sizes[r.dealt])] = _joined(sums["v"])
        kept[r.dealt] = _joined(sums["w"], np.uint8)
        rest = mine.filter(pa.array(~whole))  # runs of contexts in several parts
        first = np.searchsorted(r.bucket[r.dealt], rest["part"].to_numpy())
        kept[r.dealt[first + rest["e"].to_numpy()]] = True
        r.close(n, np.repeat(kept, r.sizes))
    return r


def _gain(t, lp, total):
    """Count times divergence of a context from the shorter one: ``t`` sums
    n log n over its events, ``lp`` the log-probabilities behind the shorter."""
    return t - lp - total * np.log(np.maximum(total, 1))


def _sum_bucket(rows: pa.Table, least: int, evidence: float, steps: bool = False) -> pa.Table:
    """The contexts of a bucket: an answer for every block's row; sums and a
    row for every run, where a context stands in several parts.  With
    ``steps`` contexts and symbols are differences (``_halves``, ``_steps``)
    and the log-probabilities whole numbers of ``UNIT``."""
    bucket = rows["bucket"][0].as_py()
    context = np.concatenate([_whole(_unpack(x, np.uint64)) if steps else _unpack(x, np.uint64)
                              for x in rows["context"].to_pylist()])
    parts, sizes = _joined(rows["parts"]), _joined(rows["sizes"])
    lp = -UNIT * _joined(rows["lp"]) if steps else _joined(rows["lp"], np.float64)
    symbols, n = _joined(rows["symbols"]), _joined(rows["n"])
    symbols = _climbed(symbols, sizes) if steps else symbols
    n_runs = np.array([len(_unpack(x, np.int64)) for x in rows["sizes"].to_pylist()], np.int64)
    ids, group = np.unique(context, return_inverse=True)
    events = np.repeat(group, sizes)
    order = np.lexsort((symbols, events))
    new = np.r_[True, (events[order][1:] != events[order][:-1]) | (symbols[order][1:] != symbols[order][:-1])]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    total = np.bincount(which, n)
    of = events[order][new]

    def per(x, by=of):
        return np.bincount(by, x, len(ids))

    t, different, all_ = per(total * np.log(np.maximum(total, 1))), per(total > 0), per(total)
    lps = per(lp, group)
    split = np.zeros(len(ids), bool)
    split[group[parts > 1]] = True
    kept = (all_ > 0) & ~split & (_gain(t, lps, all_) >= evidence * different)
    answer = total[which].astype(np.int64)
    answer[(answer < least) & ~(kept | split)[events]] = 0   # nobody asks for these
    runs = np.r_[0, np.cumsum(n_runs)]
    cuts = np.r_[0, np.cumsum(sizes)][runs]
    b = rows["b"].to_numpy()
    asks = np.flatnonzero(split[group])
    row_of = np.repeat(np.arange(len(b)), n_runs)
    some = np.flatnonzero(split)
    n_all = (len(b), len(asks), len(some))

    def column(kind, answers=None, asked=None, sums=None):
        return pa.chunked_array([pa.nulls(k, kind) if x is None else pa.array(x, kind) if not isinstance(
            x, pa.Array) else x for x, k in zip((answers, asked, sums), n_all, strict=True)])

    return pa.table({
        "b": column(pa.int64(), b, b[row_of[asks]]),
        "bucket": column(pa.int32(), *[np.full(k, bucket, np.int32) for k in n_all]),
        "e": column(pa.int32(), np.full(len(b), -1, np.int32), (asks - runs[row_of[asks]]).astype(np.int32)),
        "v": column(pa.binary(), _packs(answer, cuts)),
        "w": column(pa.binary(), _packs(kept[group].astype(np.uint8), runs)),
        "context": column(pa.int64(), None, context[asks].view(np.int64), ids[some].view(np.int64)),
        "t": column(pa.float64(), None, None, t[some]),
        "different": column(pa.int64(), None, None, different[some].astype(np.int64)),
        "total": column(pa.float64(), None, None, all_[some]),
        "lp": column(pa.float64(), None, None, lps[some])}).combine_chunks()


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          depth: int = DEPTH, min_count: int = MIN_COUNT, evidence: float = EVIDENCE,
          mu: float = MU, root_share: float = ROOT_SHARE, part: int = PART, bucket: int = BUCKET) -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` (log10 probability of the text) and
    ``n_in_context`` (tokens scored in a context of a word or more) of every
    row.  Rows where ``held_out`` holds are scored but not learnt from."""
    if min(depth, min_count, part, bucket) < 1:
        raise ValueError("depth, min_count, part and bucket must be 1 or more")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    with shuffles_end_with_jobs(spark), Scratch(spark) as tables:
        src = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").cast("binary").alias("raw"),
                          F.coalesce(~held_out, F.lit(True)).alias("train"))
        coded = tables.write(_code(src, kind))
        answers, totals = _vocabulary(coded, min_count, root_share, part, bucket, tables)
        # the words themselves are not read again
        blocks = tables.write(coded.drop("words", "counts"))
        tables.drop(coded)
        for d in range(1, depth + 1):
            answers = answers.unionByName(_answers(blocks, answers, totals, d, evidence, mu, tables))

        def rows(block: pa.Table, found: pa.Table) -> pa.Table:
            r = _replayed(block, found, totals, mu, depth)
            n = len(r.starts)

            def total(x):
                return pa.array(np.add.reduceat(x, r.starts))

            return pa.table({
                "k": block["k"].combine_chunks().flatten(),
                "held_out": pa.array(_unpack(block["train"][0].as_py(), np.uint8) == 0),
                "n_tokens": pa.array(r.n), "n_known": total((r.known > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, totals.tokens, np.int64)),
                "base_score": total(np.log10(r.p0)), "score": total(np.log10(r.p * r.within)),
                "n_in_context": total((r.depth > 0).astype(np.int64))})

        out = T.StructType([T.StructField("k", kind), *T._parse_datatype_string(
            "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
            "score double, n_in_context long").fields])
        done = cut_lineage(blocks.groupBy("block").cogroup(answers.groupBy("b"))
                           .applyInArrow(rows, out))
    return done.withColumnRenamed("k", id_col)


def _answers(blocks: DataFrame, answers: DataFrame, totals: Totals, d: int, evidence: float, mu: float,
             tables: Scratch) -> DataFrame:
    """Answers of the contexts of ``d`` words: their events' counts, and which
    of them are retained."""
    def events(block: pa.Table, found: pa.Table) -> pa.Table:
        r = _replayed(block, found, totals, mu, d - 1)
        r.open()
        # a logarithm is rounded by itself, so that sums do not depend on the blocks
        logs = np.rint(np.log(r.shorter) / -UNIT).astype(np.int64)
        lp = np.add.reduceat(r.in_train * logs, r.runs) if len(r.runs) else np.zeros(0, np.int64)
        at = r.dealt
        cuts = np.r_[np.unique(r.bucket[at], return_index=True)[1], len(at)]
        context, flat = r.context[r.runs[at]], _ranges(r.runs[at], r.sizes[at])
        ends = np.r_[0, np.cumsum(r.sizes[at])][cuts]
        return pa.table({
            "bucket": pa.array(r.bucket[at[cuts[:-1]]].astype(np.int32)),
            "b": pa.array(np.full(len(cuts) - 1, block["block"][0].as_py(), np.int64)),
            "context": pa.array([_pack(_halves(context[lo:hi])) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)],
                                pa.binary()),
            "parts": _packs(r.parts[at], cuts),
            "sizes": _packs(r.sizes[at], cuts), "lp": _packs(lp[at], cuts),
            "symbols": _packs(_steps(r.number[r.next[flat]].astype(np.int64), r.sizes[at]), ends),
            "n": _packs(r.in_train[flat], ends)})

    rows = blocks.drop("k").groupBy("block").cogroup(answers.groupBy("b")).applyInArrow(
        events, _schema(EVENTS))
    summed = tables.write(rows.groupBy("bucket").applyInArrow(
        lambda t: _sum_bucket(t, totals.least, evidence, True), _schema(SUMMED)))
    total = F.col("total")
    split = (summed.filter("b IS NULL").groupBy("context")
             .agg(*[F.sum(c).alias(c) for c in ("t", "different", "total", "lp")])
             .filter((total > 0) & (F.col("t") - F.col("lp") - total * F.log(total)
                                    >= F.lit(evidence) * F.col("different"))).select("context"))
    asks = summed.filter("b IS NOT NULL AND e >= 0").join(split, "context", "left_semi")
    out = tables.write(summed.filter("e < 0").unionByName(asks.select(summed.columns)).select(
        "b", F.lit(d).alias("level"), F.col("bucket").alias("part"), "e", "v", "w",
        F.lit(None).cast("binary").alias("x")))
    tables.drop(summed)
    return out


@query("op12_suffix_tree_scores")
def op12_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learnt from those whose id's CRC-32 leaves no 2 by 7."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(load(spark, sf_dir, "documents"), held_out)
