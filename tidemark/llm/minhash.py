"""Near-duplicates by HyperMinHash sketches.

Every text's set of word shingles is kept as 128 registers of 16 bits: the
smallest hash of each of 128 buckets, stored as its leading-zero count and
ten mantissa bits.  Four registers make one band (64 bits, compared as they
are); a pair that shares a band is a candidate.  The candidate's similarity
is estimated from its equal registers, less the collisions expected for its
set sizes, and every pair that the estimate doesn't rule out is confirmed on
the full shingle sets.  At the threshold itself a pair shares no band with
probability 5e-6.

No group is ever expanded into its pairs:

* Texts with equal sets form one class (an aggregate on a 128-bit digest);
  only its smallest id goes on.
* Inside a band's bucket every member is first compared with the smallest
  one, the pivot.  The confirmed links are turned into components.
* Members of one pivot that then lie in several components are compared
  completely, but only across components: they are dealt into blocks of a
  bounded number of shingles, block pairs are the tasks, and a task
  estimates and confirms its pairs where they are.  It hands on only links
  that join components, fewer than its members.

Defined results: texts without words have no shingles and link with
nothing; NULL ids have a NULL component, are kept, and link with nothing;
rows that repeat an id are one vertex and each row keeps its own set size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

from .batches import groups, slices
from .links import Scratch, components, salted_left_join
from .registry import load, query
from .shingles import shingle_set

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
ROWS_PER_BAND = 4          # 16-bit registers in one 64-bit band
BANDS = REGISTERS // ROWS_PER_BAND
EMPTY = 0xFFFF
EMPTY_BAND = -1            # four empty registers
DEVIATIONS = 5             # an estimate may lie so many standard deviations too low
BLOCK = 1 << 19            # shingles of one pivot's members in one block


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of sorted distinct 64-bit hashes."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rest = hashes[first] << np.uint64(BUCKET_BITS)
        # bits of the upper 53, which a double holds exactly
        zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
        zeros = zeros.astype(np.uint64)
        mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
        out[bucket[first]] = (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
    """Similarity of paired sketches (rows of registers) with set sizes
    ``na`` and ``nb``, and the number of registers it rests on.

    Unequal elements give equal registers now and then; the expected number
    (HyperMinHash's approximation for 2^p buckets and r mantissa bits) is
    taken off the count of equal ones.
    """
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    phi = 4.0 * na * nb / (na + nb) ** 2
    by_chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * phi
    return (equal - by_chance) / np.maximum(used, 1), used


def passes(a, b, na, nb, similarity: float) -> np.ndarray:
    """Pairs that neither their sizes nor the estimate rule out."""
    j, used = estimate(a, b, na, nb)
    slack = DEVIATIONS * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1))
    return (j >= similarity - slack) & (np.minimum(na, nb) >= similarity * np.maximum(na, nb))


def _sketches(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(-1, BANDS).view(np.uint16)


def sketch(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           words: int = 5) -> DataFrame:
    """``id``, ``n`` (set size), ``set_key`` (digest of the set) and ``bands``
    (the registers, four to a number) of every row; NULL key and bands for
    an empty set."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("v"))

    def run(batches):
        for b in slices(batches, 1):
            n, key, bands = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(registers(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "set_key", "bands"])

    schema = T.StructType([T.StructField("id", src.schema["id"].dataType),
                           T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])
    return src.mapInArrow(run, schema)


def _packed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``z`` (compressed text), to move less."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("z"))

    def run(batches):
        import zstandard
        z = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, 1):
            out = [z.compress((t or "").encode("utf-8", "surrogatepass"))
                   for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())],
                                             names=["id", "z"])

    return src.filter("id IS NOT NULL").mapInArrow(
        run, T.StructType([T.StructField("id", src.schema["id"].dataType),
                           T.StructField("z", T.BinaryType())]))


def confirm(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets reach ``similarity``."""
    per_cent = round(100 * similarity)

    def run(batches):
        import zstandard
        z = zstandard.ZstdDecompressor()
        for batch in slices(batches, 3):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sets: dict = {}  # of this batch, few at a time
            keep = []

            def full(packed, sets=sets):
                if packed not in sets:
                    if len(sets) > 256:
                        sets.clear()
                    sets[packed] = shingle_set(
                        z.decompress(packed).decode("utf-8", "surrogatepass"), words)
                return sets[packed]

            for zx, zy in zip(left, right, strict=True):
                p, q = full(zx), full(zy)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= per_cent * (len(p) + len(q) - both) and both > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left = texts.select(F.col("id").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("id").alias("b"), F.col("z").alias("zb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb")
    return rows.mapInArrow(run, pairs.select("a", "b").schema).distinct()


def _estimated(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs that pass the estimate."""
    def run(batches):
        for b in batches:
            ok = passes(_sketches(b.column(4)), _sketches(b.column(5)),
                        b.column(2).to_numpy(), b.column(3).to_numpy(), similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)],
                                             names=["a", "b"]).filter(pa.array(ok))

    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bands").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("sb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
    return rows.mapInArrow(run, pairs.select("a", "b").schema)


def _links_across(own, ids, roots, sets, one_block: bool, similarity: float):
    """Links between different components among a group's members that join
    components not joined before (inside one block, or between two)."""
    per_cent = round(100 * similarity)
    n = np.array([len(s) for s in sets])
    regs = np.stack([registers(s) for s in sets])
    joined: dict = {}

    def find(x):
        while x in joined:
            x = joined[x]
        return x

    left = np.arange(len(ids)) if one_block else np.flatnonzero(own == own.min())
    right = np.arange(len(ids)) if one_block else np.flatnonzero(own != own.min())
    for i in left.tolist():
        j = right[right > i] if one_block else right
        j = j[roots[j] != roots[i]]
        if not len(j):
            continue
        j = j[passes(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], n[i], n[j], similarity)]
        for k in j.tolist():
            a, b = find(roots[i]), find(roots[k])
            if a == b:
                continue
            p, q = sets[i], sets[k]
            at = np.searchsorted(p, q)
            at[at == len(p)] = 0
            both = int((p[at] == q).sum())
            if 100 * both >= per_cent * (len(p) + len(q) - both):
                joined[max(a, b)] = min(a, b)
                yield ids[i], ids[k]


def _across(members: DataFrame, texts: DataFrame, words: int, similarity: float,
            block: int) -> DataFrame:
    """Confirmed links between components among the members of each pivot.

    ``members``: ``pivot``, ``id``, ``root``, ``blocks`` (of about ``block``
    shingles, by the sum of the group's set sizes).
    """
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = (members.join(texts.hint("merge"), "id").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("pivot", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                    "own", "id", "root", "z")
            .repartition("pivot", "p", "q").sortWithinPartitions("pivot", "p", "q", "id"))

    def run(batches):
        import zstandard
        z = zstandard.ZstdDecompressor()
        for g in groups(batches, 3):
            own, ids, roots = (g.column(i).to_numpy() for i in (3, 4, 5))
            if (roots == roots[0]).all():
                continue
            sets = [shingle_set(z.decompress(x).decode("utf-8", "surrogatepass"), words)
                    for x in g.column(6).to_pylist()]
            one = g.column(1)[0] == g.column(2)[0]
            if not one and (own == own[0]).all():
                continue
            found = list(_links_across(own, ids, roots, sets, one, similarity))
            if found:
                a, b = (np.array(x, np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 5, similarity: float = 0.75, block: int = BLOCK) -> DataFrame:
    """``id_col`` (whole numbers), ``n_shingles``, ``component_id`` and
    ``kept`` of every row."""
    df = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col))
    with Scratch(df.sparkSession) as tables:
        sketches = tables.write(sketch(df, id_col, text_col, words))
        usable = sketches.filter("n > 0 AND id IS NOT NULL")

        # classes of equal sets
        classes = (usable.groupBy("set_key").agg(F.min("id").alias("rep"), F.max("id").alias("top"))
                   .filter("rep < top").select("set_key", "rep"))
        rows = salted_left_join(sketches, tables.write(classes), "set_key", "id").withColumn(
            "rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
        rows = tables.write(rows.select("id", "n", "rep", F.when(
            F.col("id") == F.col("rep"), F.col("bands")).alias("bands")))
        reps = rows.filter("bands IS NOT NULL AND n > 0").select("id", "n", "bands")

        # buckets with several members, and their smallest one
        spread = (reps.select("id", "n", F.posexplode("bands").alias("band", "key"))
                  .filter(F.col("key") != EMPTY_BAND))
        buckets = tables.write(spread.groupBy("band", "key").agg(
            F.min("id").alias("pivot"), F.max("id").alias("top")).filter("pivot < top").drop("top"))
        members = tables.write(spread.join(buckets, ["band", "key"]).filter("id <> pivot")
                               .groupBy("pivot", "id").agg(F.max("n").alias("n")))
        ends = members.select("id").union(members.select("pivot")).distinct()
        # no bound is known for the ids, so they are never broadcast
        texts = tables.write(_packed_texts(df, id_col, text_col)
                             .join(ends.hint("merge"), "id", "left_semi"))

        starred = members.select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        starred = tables.write(_estimated(starred, reps, similarity))
        roots = tables.write(components(tables.write(confirm(starred, texts, words, similarity))))

        # pivots whose members lie in several components
        placed = salted_left_join(members, roots, "id", "pivot").withColumn(
            "root", F.coalesce("root", "id"))
        placed = tables.write(placed.select("pivot", "id", "n", "root"))
        open_ = (placed.groupBy("pivot")
                 .agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                      F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"))
                 .filter("lo < hi").select("pivot", "blocks"))
        dealt = salted_left_join(placed, tables.write(open_), "pivot", "id")
        more = tables.write(_across(dealt.filter("blocks IS NOT NULL"), texts, words, similarity,
                                    block))
        if not more.isEmpty():
            roots = tables.write(components(
                more.unionByName(roots.select(F.col("root").alias("a"), F.col("id").alias("b")))))

        named = salted_left_join(rows.select("id", "n", "rep"),
                                 roots.withColumnRenamed("id", "rep"), "rep", "id")
        component = F.coalesce("root", "rep")
        return cut_lineage(named.select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            (F.col("id").isNull() | (F.col("id") == component)).alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             words: int = 5, similarity: float = 0.75) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id.  Rows with
    a NULL id stay."""
    found = near_duplicates(docs, id_col, text_col, words, similarity)
    gone = cut_lineage(found.filter("NOT kept").select(F.col(id_col)).distinct())
    return docs.join(gone.hint("merge"), id_col, "left_anti").select(*docs.columns)


@query("op1_hyperminhash_dedup")
def op1_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size, component and verdict of every document."""
    return near_duplicates(load(spark, sf_dir, "documents"))
