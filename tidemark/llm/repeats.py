"""Repeated passages across a corpus by bucket-pointer refinement.

A place is removed when it is covered by a ``LENGTH``-byte string that also
starts earlier.  Suffixes are refined only as deep as that length:

1. Initial buckets are q-grams.  A bucket identifier is a 64-bit hash built
   by doubling: the identifier at depth 2k is made of the identifier at
   depth k and the one k places later (8, 16, 32, 64 bytes; a whole string
   of 100 is the pair of 64-byte identifiers at offsets 0 and 36).
2. Of the q-grams of every ``LENGTH``-byte string only the one with the
   smallest identifier stands for it, so that equal strings choose the same
   one.  Consecutive strings with one representative form a run; runs, about
   one for 35 places, are dealt by bucket.  Runs of one bucket with the same
   identifiers of their first and last string are equal throughout: all but
   the earliest are settled as repeats.  A bucket whose runs all agree is
   finished.
3. Only runs of buckets that hold different runs (the ends of matches and
   edited places) are refined to single strings: the run's bytes go to the
   bucket's task, which sorts the strings by their pairs of identifiers.

Skew: a task first compares the runs of its own Arrow batch, settles the
repeats among them, and sends on only the earliest, so a passage that a
third of all documents hold arrives once per batch.  The different runs of
one bucket are gathered only while they are few: a task counts them over its
batches, and beyond a number of them in a window of ``WINDOW`` runs (about 150
MB of text) it marks the bucket, whose strings are then dealt one by one by
their own identifiers, also those of other tasks.  The number is ``NEAR`` or
less, so that all windows of the corpus together send about ``GATHERED`` runs
of a bucket (or ``FAR`` each, in a corpus of more than a TB); a bucket of more
than ``HOT`` among them is spread as well.

Texts move compressed, and only twice.  Matches never cross documents.

Defined results: NULL and empty texts have no bytes; a row with a NULL id
takes no part and comes back whole; rows that repeat an id and a text are
one document, each gets the result; different texts with one id are documents
of their own, in the order of their hashes (``sub``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

from .batches import groups, slices
from .links import Scratch
from .registry import load, query
from .shingles import mix

_U = np.uint64
LENGTH = 100
Q = 32
SPAN = LENGTH - Q + 1          # q-grams in one string
DEEP = 64
REST = LENGTH - DEEP           # second identifier's offset
CHUNK = 1 << 18                # places of one text scanned at once
PLACE = _U((1 << 20) - 1)      # bits of a place inside a chunk
HOT = 4096                     # different runs of one bucket that one task compares
NEAR, FAR = 256, 8             # different runs of one bucket that a window sends to its task
GATHERED = 1 << 16             # and that all windows send, about
WINDOW = 1 << 22               # different runs counted together
WINDOW_BYTES = 50 << 20        # of a stored table that make about one window
PIECE = 1 << 14                # settled strings that travel together
COUNTERS, BITS = 1 << 21, 1 << 23
SETTLED, OPEN, SPREAD = 0, 1, 2
DEALS = 4                      # deals for each shuffle partition


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Identifier of the string that two identifiers make up together."""
    return mix(x * _U(0x9E3779B97F4A7C15) + (y ^ (y >> _U(29))) * _U(0xC2B2AE3D27D4EB4F))


def _eights(raw) -> np.ndarray:
    """The 8 bytes at every place, as one number."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", buffer=raw, strides=(1,))


def pointers(raw) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of every place at depth ``Q`` and ``DEEP``."""
    b8 = _eights(raw).copy()
    b16 = _pair(b8[:-8], b8[8:])
    b32 = _pair(b16[:-16], b16[16:])
    return b32, _pair(b32[:-32], b32[32:])


def _pack(start, count, offset, kind):
    """Start of a run, its strings, its q-gram's offset and a kind in one number."""
    return (np.asarray(start, np.int64) << 16) | (np.asarray(count, np.int64) << 9) | (
        np.asarray(offset, np.int64) << 2) | kind


def _unpack(p: np.ndarray):
    return p >> 16, (p >> 9) & 127, (p >> 2) & 127, p & 3


def scan(raw: bytes):
    """Runs of a text: bucket, identifier of the run, start, strings, offset."""
    parts = []
    for lo in range(0, len(raw) - LENGTH + 1, CHUNK):
        piece = raw[lo:lo + CHUNK + LENGTH - 1]
        b32, b64 = pointers(piece)
        low = (b32 & ~PLACE) | np.arange(len(b32), dtype=np.uint64)
        size = 1
        while 2 * size <= SPAN:  # smallest identifier of each string's q-grams
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:size - SPAN], low[SPAN - size:]) if SPAN > size else low
        at = (low & PLACE).astype(np.int64)
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[start, len(at)])
        last = start + count - 1
        offset = at[start] - start
        whole = _pair(_pair(b64[start], b64[start + REST]), _pair(b64[last], b64[last + REST]))
        shape = (count * 128 + offset).astype(np.uint64)
        parts.append((b32[at[start]], _pair(whole, shape), start + lo, count, offset))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


def _first_of(keys: list[np.ndarray], doc: np.ndarray, sub: np.ndarray, place: np.ndarray):
    """Order by keys, document and place; the groups' starts in that order;
    and which rows have an earlier, different place in their group."""
    order = np.lexsort((place, sub, doc, *reversed(keys)))
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, s, p = doc[order], sub[order], place[order]
    later = (d != d[head]) | (s != s[head]) | (p != p[head])
    return order, new, later


def _arrays(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()),
                                    pa.array(values.view(np.int64) if values.dtype == np.uint64
                                             else values, pa.int64()))


def _deal(deal: np.ndarray, kind: int, *columns):
    """A record batch with one row for each deal, arrays in its columns."""
    order = np.argsort(deal, kind="stable")
    d = deal[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, d[1:] != d[:-1]]), len(d)] if len(d) else np.zeros(1, int)
    n = len(cuts) - 1
    cols = [_arrays(c[order], cuts) if c is not None
            else pa.array([[]] * n, pa.list_(pa.int64())) for c in columns]
    return [pa.array(d[cuts[:-1]].astype(np.int32), pa.int32()),
            pa.array(np.full(n, kind, np.int32), pa.int32()), *cols], order, cuts


def _column(table: pa.Table, i: int) -> np.ndarray:
    """All numbers of an array column."""
    flat = table.column(i).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _by_kind(table: pa.Table) -> dict[int, pa.Table]:
    kind = table.column(1).to_numpy()
    return {int(k): table.filter(pa.array(kind == k)) for k in np.unique(kind)}


FOUND = "doc long, sub long, p long"


def _found(doc: np.ndarray, sub: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(sub), pa.array(p)],
                                      names=["doc", "sub", "p"])


def _spread(doc: np.ndarray, place: np.ndarray, deals: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64) * _U(31) + place.astype(np.uint64)) % _U(deals)).astype(np.int64)


def _pieces(doc: np.ndarray, place: np.ndarray, deals: int) -> np.ndarray:
    """Deals of rows that need not meet any others: few pieces, anywhere."""
    return (_spread(doc[:1], place[:1], deals) + np.arange(len(doc)) // PIECE) % deals


def _near(df: DataFrame) -> int:
    """Different runs of one bucket that a window may send."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(FAR, min(NEAR, GATHERED // (1 + size // WINDOW_BYTES)))


_RUNS = ("deal int, kind int, bucket array<long>, run array<long>, doc array<long>, p array<long>, "
         "sub array<long>")
_RUN_NAMES = ["deal", "kind", "bucket", "run", "doc", "p", "sub"]


class Variants:
    """Different runs that a task has met, counted by bucket in a bounded
    table.  Buckets that share a counter, and runs met in an earlier window,
    only mark more buckets; a run that shares its bit is not counted."""

    def __init__(self, near: int = NEAR):
        self.near = min(near, HOT)
        self.clear()

    def clear(self):
        self.count = np.zeros(COUNTERS, np.int32)
        self.seen = np.zeros(BITS, bool)
        self.n = 0

    def many(self, bucket: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Takes up different runs; whether the bucket of each has too many."""
        if self.n > WINDOW:
            self.clear()
        bit = _pair(bucket, run) % _U(BITS)
        fresh = ~self.seen[bit]
        self.seen[bit] = True
        self.n += int(fresh.sum())
        counter = bucket % _U(COUNTERS)
        np.add.at(self.count, counter[fresh], 1)
        return self.count[counter] > self.near


def _scan_batch(docs, subs, texts, deals: int, variants: Variants):
    """The batch's runs: the earliest of equal ones by bucket, the rest settled."""
    found = [(d, u, scan((t or "").encode("utf-8", "surrogatepass")))
             for d, u, t in zip(docs, subs, texts, strict=True)]
    found = [(d, u, x) for d, u, x in found if x is not None]
    if not found:
        return
    doc, sub = (np.concatenate([np.full(len(f[2][0]), f[i], np.int64) for f in found]) for i in (0, 1))
    bucket, run, start, count, offset = (np.concatenate(c) for c in
                                         zip(*(x for *_, x in found), strict=True))
    del found
    order, new, later = _first_of([bucket, run], doc, sub, start)
    doc, sub, bucket, run, start, count, offset = (
        x[order] for x in (doc, sub, bucket, run, start, count, offset))
    if later.any():
        d, s = doc[later], start[later]
        yield _deal(_spread(d, s, deals), 1, None, None, d,
                    _pack(s, count[later], offset[later], SETTLED), sub[later])[0]
    # the different runs of each bucket
    different = np.flatnonzero(new)
    hot = variants.many(bucket[different], run[different])
    rest, keep = different[~hot], different[hot]
    yield _deal((bucket[rest] % _U(deals)).astype(np.int64), 0, bucket[rest], run[rest], doc[rest],
                _pack(start[rest], count[rest], offset[rest], OPEN), sub[rest])[0]
    if len(keep):
        d, s = doc[keep], start[keep]
        yield _deal(_spread(d, s, deals), 2, None, None, d,
                    _pack(s, count[keep], offset[keep], SPREAD), sub[keep])[0]
        marks = np.unique(bucket[keep])
        yield _deal((marks % _U(deals)).astype(np.int64), 3, marks, None, None, None, None)[0]


def _judge_runs(bucket, run, doc, p, sub, marks):
    """Settled and open runs of whole buckets."""
    start, count, offset, _ = _unpack(p)
    order, new, later = _first_of([bucket, run], doc, sub, start)
    bucket, doc, sub, start, count, offset = (
        x[order] for x in (bucket, doc, sub, start, count, offset))
    group = np.cumsum(np.r_[True, bucket[1:] != bucket[:-1]]) - 1
    variants = np.bincount(group, new)[group]
    marked = np.isin(bucket, marks)
    open_ = new & ((variants > 1) | marked)
    kind = np.where(marked | (variants > HOT), SPREAD, OPEN)
    out_p = np.where(later, _pack(start, count, offset, SETTLED), _pack(start, count, offset, kind))
    keep = later | open_
    return doc[keep], sub[keep], out_p[keep]


def _places(df: DataFrame, id_col: str, text_col: str, deals: int) -> DataFrame:
    """``doc``, ``sub`` and packed ``p`` of settled and of open runs."""
    text = F.col(text_col).cast("string")
    src = (df.filter(F.col(id_col).isNotNull())
           .select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("sub"), text.alias("t")))
    near = _near(df)

    def local(batches):
        variants = Variants(near)
        for b in slices(batches, 2):
            for cols in _scan_batch(b.column(0).to_numpy(), b.column(1).to_numpy(),
                                    b.column(2).to_pylist(), deals, variants):
                yield pa.RecordBatch.from_arrays(cols, names=_RUN_NAMES)

    def judge(batches):
        for deal in groups(batches, 1):
            by_kind = _by_kind(deal)
            for k in (1, 2):
                if k in by_kind:
                    yield _found(*(_column(by_kind[k], i) for i in (4, 6, 5)))
            if 0 in by_kind:
                marks = _column(by_kind[3], 2) if 3 in by_kind else np.zeros(0, np.int64)
                yield _found(*_judge_runs(*(_column(by_kind[0], i) for i in range(2, 7)), marks))

    return (src.mapInArrow(local, _RUNS).repartition("deal").sortWithinPartitions("deal")
            .mapInArrow(judge, FOUND))


_STRINGS = ("deal int, kind int, k1 array<long>, k2 array<long>, doc array<long>, p array<long>, "
            "sub array<long>, spans binary")
_STRING_NAMES = ["deal", "kind", "k1", "k2", "doc", "p", "sub", "spans"]


def _each(count: np.ndarray) -> np.ndarray:
    """0..count-1 for every count, concatenated."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _string_keys(buffer: bytes, at: np.ndarray):
    """The pair of identifiers of the strings that start at places ``at``."""
    e = _eights(buffer)

    def b32(x):
        return _pair(_pair(e[x], e[x + 8]), _pair(e[x + 16], e[x + 24]))

    def b64(x):
        return _pair(b32(x), b32(x + 32))
    return b64(at), b64(at + REST)


def _open_batch(rows, deals: int):
    """Bytes of open runs by bucket; strings of spread runs by identifier."""
    doc, sub, p, spans = [], [], [], []
    for d, u, raw, ps in rows:
        ps = np.array(ps, np.int64)
        ps = ps[(ps & 3) != SETTLED]
        start, count, _, _ = _unpack(ps)
        for x, s, c in zip(ps.tolist(), start.tolist(), count.tolist(), strict=True):
            doc.append(d)
            sub.append(u)
            p.append(x)
            spans.append(raw[s:s + c + LENGTH - 1])
    if not doc:
        return
    doc, sub, p = (np.array(x, np.int64) for x in (doc, sub, p))
    length = np.fromiter(map(len, spans), np.int64, len(spans))
    begin = np.cumsum(length) - length
    buffer = b"".join(spans)
    start, count, offset, kind = _unpack(p)
    by_bucket = kind == OPEN
    if by_bucket.any():
        e = _eights(buffer)
        at = (begin + offset)[by_bucket]
        bucket = _pair(_pair(e[at], e[at + 8]), _pair(e[at + 16], e[at + 24]))
        cols, order, cuts = _deal((bucket % _U(deals)).astype(np.int64), 0, None, None,
                                  doc[by_bucket], p[by_bucket], sub[by_bucket])
        which = np.flatnonzero(by_bucket)[order]
        blobs = [b"".join(spans[i] for i in which[lo:hi])
                 for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        yield [*cols, pa.array(blobs, pa.binary())]
    if not by_bucket.all():
        far = ~by_bucket
        n = count[far]
        step = _each(n)
        k1, k2 = _string_keys(buffer, np.repeat(begin[far], n) + step)
        d, u, s = np.repeat(doc[far], n), np.repeat(sub[far], n), np.repeat(start[far], n) + step
        order, new, later = _first_of([k1, k2], d, u, s)
        k1, k2, d, u, s = (x[order] for x in (k1, k2, d, u, s))
        if later.any():
            yield [*_deal(_pieces(d[later], s[later], deals), 2, None, None, d[later],
                          _pack(s[later], 1, 0, SETTLED), u[later])[0], None]
        yield [*_deal((k1[new] % _U(deals)).astype(np.int64), 1, k1[new], k2[new], d[new], s[new],
                      u[new])[0], None]


def _packed_runs(doc: np.ndarray, sub: np.ndarray, place: np.ndarray):
    """Single strings as runs of up to 127."""
    order = np.lexsort((place, sub, doc))
    doc, sub, place = doc[order], sub[order], place[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (place[1:] != place[:-1] + 1)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    new |= (np.arange(len(doc)) - head) % 127 == 0
    first = np.flatnonzero(new)
    return doc[first], sub[first], _pack(place[first], np.diff(np.r_[first, len(doc)]), 0, SETTLED)


def _repeated_strings(texts: DataFrame, places: DataFrame, deals: int) -> DataFrame:
    """``doc``, ``sub`` and ``p`` of repeated strings among the open runs."""
    rows = texts.join(places.filter(F.exists("ps", lambda p: p.bitwiseAND(F.lit(3)) != SETTLED)),
                      ["id", "sub"]).select("id", "sub", "z", "ps")

    def local(batches):
        import zstandard
        z = zstandard.ZstdDecompressor()
        for part in slices(batches, 2):
            rows = ((d, u, z.decompress(x), ps) for d, u, x, ps in
                    zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
            for cols in _open_batch(rows, deals):
                if cols[-1] is None:
                    cols[-1] = pa.nulls(len(cols[0]), pa.binary())
                yield pa.RecordBatch.from_arrays(cols, names=_STRING_NAMES)

    def judge(batches):
        for deal in groups(batches, 1):
            by_kind = _by_kind(deal)
            keys = []
            if 2 in by_kind:
                yield _found(*(_column(by_kind[2], i) for i in (4, 6, 5)))
            if 1 in by_kind:
                keys.append([_column(by_kind[1], i) for i in range(2, 7)])
            if 0 in by_kind:
                doc, p, sub = (_column(by_kind[0], i) for i in (4, 5, 6))
                start, count, _, _ = _unpack(p)
                length = count + LENGTH - 1
                begin = np.cumsum(length) - length
                step = _each(count)
                k1, k2 = _string_keys(b"".join(by_kind[0].column(7).to_pylist()),
                                      np.repeat(begin, count) + step)
                keys.append([k1.view(np.int64), k2.view(np.int64), np.repeat(doc, count),
                             np.repeat(start, count) + step, np.repeat(sub, count)])
            if not keys:
                continue
            k1, k2, doc, place, sub = (np.concatenate(c) for c in zip(*keys, strict=True))
            order, _, later = _first_of([k1, k2], doc, sub, place)
            if later.any():
                yield _found(*_packed_runs(*(x[order][later] for x in (doc, sub, place))))

    return (rows.mapInArrow(local, _STRINGS).repartition("deal").sortWithinPartitions("deal")
            .mapInArrow(judge, FOUND))


def _pack_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``sub`` (the text's hash) and ``z``, the compressed text."""
    text = F.col(text_col).cast("string")
    src = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("sub"), text.alias("z"))

    def run(batches):
        import zstandard
        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, 2):
            out = [z.compress((t or "").encode("utf-8", "surrogatepass"))
                   for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())],
                                             names=["id", "sub", "z"])

    return src.mapInArrow(run, "id long, sub long, z binary")


def merge(ps, size: int) -> list[tuple[int, int]]:
    """Maximal removed ranges of a text of ``size`` bytes."""
    if not len(ps):
        return []
    start, count, _, _ = _unpack(np.sort(np.asarray(ps, np.int64)))
    end = np.maximum.accumulate(np.minimum(start + count + LENGTH - 1, size))
    new = np.r_[True, start[1:] > end[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(start) - 1]
    return [(int(a), int(b)) for a, b in zip(start[first], end[last], strict=True) if a < b]


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` (long), ``sub`` (the text's hash) and ``ps``: the packed repeated
    places of each document that has any."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = DEALS * partitions
    places = (_places(df, id_col, text_col, deals).groupBy(F.col("doc").alias("id"), "sub")
              .agg(F.collect_list("p").alias("ps")))
    with Scratch(df.sparkSession) as tables:
        return _with_strings(df, tables.write(places), id_col, text_col, deals)


def _with_strings(df, places, id_col, text_col, deals) -> DataFrame:
    """The settled places and those found among the open runs, by document."""
    texts = _pack_texts(df.filter(F.col(id_col).isNotNull()), id_col, text_col)
    strings = (_repeated_strings(texts, places, deals).groupBy(F.col("doc").alias("id"), "sub")
               .agg(F.collect_list("p").alias("more")))
    both = (places.select("id", "sub", F.filter("ps", lambda p: p.bitwiseAND(F.lit(3)) == SETTLED).alias("ps"))
            .join(strings, ["id", "sub"], "full"))
    none = F.array().cast("array<long>")
    both = both.select("id", "sub", F.concat(F.coalesce("ps", none), F.coalesce("more", none)).alias("ps"))
    return cut_lineage(both.filter(F.size("ps") > 0))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``spans`` (start and end of each maximal
    removed range, in bytes) and ``kept`` (the remaining bytes) of every row."""
    found = find_repeats(df, id_col, text_col)
    known = _pack_texts(df.filter(F.col(id_col).isNotNull()), id_col, text_col)
    unknown = _pack_texts(df.filter(F.col(id_col).isNull()), id_col, text_col)
    none = F.lit(None).cast("array<long>")
    rows = (known.join(found, ["id", "sub"], "left").select("id", "z", "ps")
            .unionByName(unknown.select("id", "z", none.alias("ps"))))

    def run(batches):
        import zstandard
        z = zstandard.ZstdDecompressor()
        for part in slices(batches, 1):
            size, spans, kept = [], [], []
            for x, ps in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = z.decompress(x)
                gone = merge(ps or [], len(raw))
                cuts = [0, *(c for s in gone for c in s), len(raw)]
                size.append(len(raw))
                spans.append([{"start": a, "end": e} for a, e in gone])
                kept.append(b"".join(raw[a:e] for a, e in zip(cuts[0::2], cuts[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated place taken out of its text; all rows and
    columns stay (a text may become empty).  A character of which a removed
    range takes only some bytes goes with it."""
    found = find_repeats(docs, id_col, text_col)
    fields = docs.schema.fields
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(fields))]
    plain = docs.toDF(*names)
    key = F.col(names[docs.columns.index(id_col)])
    same = (key.cast("long") == F.col("id")) & (F.xxhash64(F.col(names[at]).cast("string")) == F.col("sub"))
    joined = (plain.filter(key.isNotNull()).join(found, same, "left")
              .select(*names, "ps")
              .unionByName(plain.filter(key.isNull())
                           .withColumn("ps", F.lit(None).cast("array<long>"))))

    def run(batches):
        for b in slices(batches, at):
            texts = b.column(at).to_pylist()
            for i, ps in enumerate(b.column(len(names)).to_pylist()):
                if ps and texts[i]:
                    raw = texts[i].encode("utf-8", "surrogatepass")
                    cuts = [0, *(c for s in merge(ps, len(raw)) for c in s), len(raw)]
                    kept = b"".join(raw[x:y] for x, y in zip(cuts[0::2], cuts[1::2], strict=True))
                    texts[i] = kept.decode("utf-8", "ignore")
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i)
                    for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)])
    return joined.mapInArrow(run, schema).toDF(*docs.columns)


@query("op6_bucket_pointer_repeats")
def op6_bucket_pointer_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans of every document, and the digest of
    what is left."""
    cut = remove_repeats(load(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
