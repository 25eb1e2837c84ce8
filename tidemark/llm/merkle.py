"""Merkle manifest of a dataset as a persistent tree.

Every row is a leaf: a SHA-256 digest over all its columns.  The leaves of
one part (``part_col``) stand in the order of their ids; runs of ``FANOUT``
consecutive nodes become one node until one is left, the part's subroot, and
the subroots, in the order of the parts, become the root in the same way.

The tree is cut into aligned blocks of ``FANOUT ** BLOCK_LEVELS`` leaves.  A
task builds the subtree of a block; the roots of the blocks are the leaves of
the next layer, whose blocks are again built by tasks, until every part is
one node.  No task holds more than one block, whatever the table size.

Nodes are never changed (``Node``).  Tampering with a leaf makes a new
version: only the leaf's ancestors are copied, all other nodes are shared
with the version before.  Inside its block the copies are made next to the
block's own tree; above it the version goes on through the ancestors of the
block, which every block gets as a path of sibling digests, a few kilobytes
in size.  So a version costs one copy for each level.

Defined results: a NULL in any column is hashed as ``-``; NULL parts are a
part of their own, the first; NULL ids come first in their part; rows that
repeat an id are ordered by their leaf, and rows equal in all columns are
interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage_path

from .links import Scratch
from .registry import load, query

FANOUT = 8
BLOCK_LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """Bytes of one column in a leaf: its length, a colon and its value."""
    raw = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(raw).cast("string"), F.lit(":"), raw), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


class Node:
    """A node with its children; it is never changed."""

    __slots__ = ("digest", "children")

    def __init__(self, children: tuple = (), digest: str | None = None):
        self.children = children
        self.digest = digest or sha256("".join(c.digest for c in children).encode()).hexdigest()

    def replaced(self, height: int, pos: int, leaf_digest: str) -> Node:
        """The version of this tree with another leaf at ``pos``; it shares
        all nodes that are not above that leaf."""
        if height == 0:
            return Node(digest=leaf_digest)
        i, rest = divmod(pos, FANOUT ** (height - 1))
        new = self.children[i].replaced(height - 1, rest, leaf_digest)
        return Node(self.children[:i] + (new,) + self.children[i + 1:])

    def siblings(self, height: int, pos: int) -> list[tuple[str, str]]:
        """Digests before and after the node's ancestor in every run, from
        the leaf's run upwards."""
        if height == 0:
            return []
        i, rest = divmod(pos, FANOUT ** (height - 1))
        digests = [c.digest for c in self.children]
        return [*self.children[i].siblings(height - 1, rest),
                ("".join(digests[:i]), "".join(digests[i + 1:]))]


def height_of(n: int, n_layer: int, levels: int = BLOCK_LEVELS) -> int:
    """Levels above the ``n`` nodes of a block; a block of a layer with
    several blocks is always built up to its full height."""
    if n_layer > FANOUT ** levels:
        return levels
    height = 0
    while FANOUT ** height < n:
        height += 1
    return height


def build(digests: list[str], height: int) -> Node:
    nodes = [Node(digest=d) for d in digests]
    for _ in range(height):
        nodes = [Node(tuple(nodes[i:i + FANOUT])) for i in range(0, len(nodes), FANOUT)]
    return nodes[0]


def positions(df: DataFrame, part: str, order: list[str], tables: Scratch) -> DataFrame:
    """``df`` with ``pos`` (place in the part, from 0) and ``n`` (rows of the
    part).  ``order`` identifies rows but for equal ones.  The ordered rows
    are written once, so that the borders are the same for counts and rows."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = tables.write(df.repartitionByRange(F.col(part).asc_nulls_first(), *keys)
                          .withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(part, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    mine = Window.partitionBy(part)
    counts = counts.select(
        F.col(part).alias("_part"), F.col("_range").alias("_r"), F.sum("_rows").over(mine).alias("n"),
        F.coalesce(F.sum("_rows").over(mine.orderBy("_range").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(part, "_range").orderBy(*keys)
    return (placed.withColumn("_row", F.row_number().over(inside) - 1)
            .join(counts, F.col(part).eqNullSafe(F.col("_part")) & (F.col("_range") == F.col("_r")))
            .withColumn("pos", F.col("_row") + F.col("_before"))
            .drop("_row", "_before", "_part", "_r", "_range"))


def _climb(nodes: DataFrame, tables: Scratch, levels: int) -> tuple[DataFrame, DataFrame]:
    """Paths and roots of all trees over ``nodes`` (``tree``, ``pos``,
    ``digest``, ``n``): ``(tree, pos, path)`` from every node to its tree's
    root, and ``(tree, root)``.  One layer of blocks after another."""
    step = FANOUT ** levels

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n_layer = table["n"][0].as_py()
        pos, digests = table["pos"].to_pylist(), table["digest"].to_pylist()
        height = height_of(len(pos), n_layer, levels)
        tree = build(digests, height)
        paths = [[{"before": b, "after": a} for b, a in tree.siblings(height, p % step)] for p in pos]
        return pa.table({
            "tree": table["tree"], "pos": table["pos"],
            "path": pa.array(paths, pa.list_(pa.struct([("before", pa.string()),
                                                        ("after", pa.string())]))),
            "up": pa.array([p // step for p in pos], pa.int64()),
            "root": pa.array([tree.digest] * len(pos), pa.string()),
            "n_up": pa.array([-(-n_layer // step)] * len(pos), pa.int64())})

    schema = f"tree long, pos long, path {PATH}, up long, root string, n_up long"
    done = tables.write(nodes.withColumn("block", F.floor(F.col("pos") / step)).groupBy("tree", "block")
                        .applyInArrow(block, schema))
    if done.filter("n_up > 1").isEmpty():
        return done.select("tree", "pos", "path"), done.select("tree", "root").distinct()
    up = done.groupBy("tree", F.col("up").alias("pos")).agg(F.first("root").alias("digest"),
                                                             F.first("n_up").alias("n"))
    paths, roots = _climb(up, tables, levels)
    higher = paths.select("tree", F.col("pos").alias("up"), F.col("path").alias("rest"))
    return (done.join(higher, ["tree", "up"]).select("tree", "pos", F.concat("path", "rest").alias("path")),
            roots)


def manifest(df: DataFrame, leaf_col: Column, tampered_col: Column, id_col: str = "doc_id",
             part_col: str = "lang", levels: int = BLOCK_LEVELS) -> DataFrame:
    """``id_col``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (digest of
    the proof, the sibling digests from the leaf to the root),
    ``copied`` (digests of the nodes that the tampered version copies, leaf
    first; NULL where ``tampered_col`` is NULL), ``folded_root`` (root of the
    row's version) and ``verified`` of every row.  A block has
    ``FANOUT ** levels`` leaves.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    tables = Scratch(spark)
    step = FANOUT ** levels
    with tables:
        rows = tables.write(df.select(
            F.col(part_col).cast("string").alias("part"), F.col(id_col).alias("k"), leaf_col.alias("leaf"),
            tampered_col.alias("tampered"), F.monotonically_increasing_id().alias("row")))
        rows = tables.write(positions(rows, "part", ["k", "leaf", "row"], tables))
        # parts in their order, as the leaves of the tree above them
        sizes = rows.groupBy("part").agg(F.first("n").alias("part_n"))
        parts = tables.write(
            positions(sizes.withColumn("whole", F.lit(0)), "whole", ["part"], tables)
            .select("part", F.col("pos").alias("tree"), F.col("n").alias("n_parts")))
        rows = rows.join(parts.select(F.col("part").alias("p"), "tree"),
                         F.col("part").eqNullSafe(F.col("p"))).withColumn(
            "block", F.floor(F.col("pos") / step))

        def root_of(table: pa.Table) -> pa.Table:
            table = table.sort_by("pos")
            n = table["n"][0].as_py()
            tree = build(table["leaf"].to_pylist(), height_of(table.num_rows, n, levels))
            return pa.table({"tree": table["tree"].slice(0, 1), "pos": table["block"].slice(0, 1),
                             "digest": pa.array([tree.digest]), "n": pa.array([-(-n // step)], pa.int64())})

        blocks = tables.write(rows.select("tree", "block", "pos", "leaf", "n").groupBy("tree", "block")
                              .applyInArrow(root_of, "tree long, pos long, digest string, n long"))
        paths, subroots = _climb(blocks, tables, levels)
        subroots = tables.write(subroots)
        tops, root = _climb(subroots.join(parts, "tree").select(
            F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("digest"),
            F.col("n_parts").alias("n")), tables, levels)
        above = (paths.join(subroots.withColumnRenamed("root", "subroot"), "tree")
                 .join(tops.select(F.col("pos").alias("tree"), F.col("path").alias("rest")), "tree")
                 .join(F.broadcast(root.select("root")))  # one row
                 .select(F.col("tree").alias("t"), F.col("pos").alias("b"),
                         F.concat("path", "rest").alias("path"), "subroot", "root"))

        def versions(lower: pa.Table, upper: pa.Table) -> pa.Table:
            lower = lower.sort_by("pos")
            top = {c: upper[c][0].as_py() for c in ("path", "subroot", "root")}
            leaves, new = lower["leaf"].to_pylist(), lower["tampered"].to_pylist()
            height = height_of(len(leaves), lower["n"][0].as_py(), levels)
            tree = build(leaves, height)
            proofs, copies, folded = [], [], []
            rest = "".join(p["before"] + p["after"] for p in top["path"])
            for pos, tampered in enumerate(new):
                here = tree.siblings(height, pos)
                proofs.append(sha256(("".join(b + a for b, a in here) + rest).encode()).hexdigest())
                made = None
                if tampered is not None:
                    made, version, p = [], tree.replaced(height, pos, tampered), pos
                    for level in range(height, 0, -1):
                        made.append(version.digest)
                        i, p = divmod(p, FANOUT ** (level - 1))
                        version = version.children[i]
                    made = [tampered, *made[::-1]]
                    now = made[-1]
                else:
                    now = tree.digest
                for p in top["path"]:  # the version goes on above its block
                    now = sha256((p["before"] + now + p["after"]).encode()).hexdigest()
                    if made is not None:
                        made.append(now)
                copies.append(made)
                folded.append(now)
            n = len(leaves)
            return pa.table({"k": lower["k"], "leaf": lower["leaf"],
                             "subroot": pa.array([top["subroot"]] * n, pa.string()),
                             "root": pa.array([top["root"]] * n, pa.string()),
                             "proof_sha256": pa.array(proofs, pa.string()),
                             "copied": pa.array(copies, pa.list_(pa.string())),
                             "folded_root": pa.array(folded, pa.string())})

        out = T.StructType([T.StructField("k", kind)] + [
            T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256")] + [
            T.StructField("copied", T.ArrayType(T.StringType())), T.StructField("folded_root", T.StringType())])
        lower = rows.select("tree", "block", "pos", "k", "leaf", "tampered", "n")
        done, _ = cut_lineage_path(lower.groupBy("tree", "block").cogroup(above.groupBy("t", "b"))
                                   .applyInArrow(versions, out))
    return (done.withColumnRenamed("k", id_col)
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def document_leaf(text: Column) -> Column:
    return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


SHIFT = FANOUT.bit_length() - 1


def _run(digests: str, i: str) -> str:
    return f"list_slice({digests}, {FANOUT} * ({i}) + 1, {FANOUT} * ({i}) + {FANOUT})"


@query("op11_merkle_manifest", f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: {CRC_STEP})) AS t),
enc AS (
  SELECT *, row_number() OVER () AS r, translate(text, '{UPPER}', '{LOWER}') AS low,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
    || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc
  FROM documents, crc),
leaves AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS bad
  FROM enc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM leaves),
up(lang, lvl, d) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range((len(d) + {FANOUT - 1}) // {FANOUT}),
         lambda i: sha256(array_to_string({_run('d', 'i')}, '')))
  FROM up WHERE len(d) > 1),
sub AS (
  SELECT lang, lvl AS height, d[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree
  FROM up WHERE len(d) = 1),
top(lvl, d) AS (
  SELECT 0, list(subroot ORDER BY tree) FROM sub
  UNION ALL
  SELECT lvl + 1, list_transform(range((len(d) + {FANOUT - 1}) // {FANOUT}),
         lambda i: sha256(array_to_string({_run('d', 'i')}, '')))
  FROM top WHERE len(d) > 1),
steps AS (
  SELECT p.r, u.lvl, {_run('u.d', f'p.pos >> ({SHIFT} * (u.lvl + 1))')} AS run,
         (p.pos >> ({SHIFT} * u.lvl)) % {FANOUT} AS i
  FROM placed p JOIN up u ON p.lang IS NOT DISTINCT FROM u.lang AND len(u.d) > 1
  UNION ALL
  SELECT p.r, s.height + t.lvl, {_run('t.d', f's.tree >> ({SHIFT} * (t.lvl + 1))')},
         (s.tree >> ({SHIFT} * t.lvl)) % {FANOUT}
  FROM placed p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang JOIN top t ON len(t.d) > 1),
sides AS (
  SELECT r, lvl, array_to_string(list_slice(run, 1, i), '') AS before,
         array_to_string(list_slice(run, i + 2, {FANOUT}), '') AS after FROM steps),
whole AS (
  SELECT r, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof FROM sides GROUP BY r),
fold(r, lvl, d) AS (
  SELECT r, 0, coalesce(bad, leaf) FROM placed
  UNION ALL
  SELECT f.r, f.lvl + 1, sha256(s.before || f.d || s.after) FROM fold f JOIN sides s ON s.r = f.r AND s.lvl = f.lvl),
ends AS (SELECT r, max_by(d, lvl) AS d FROM fold GROUP BY r),
root AS (SELECT d[1] AS root FROM top WHERE len(d) = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.root, coalesce(w.proof, sha256('')) AS proof_sha256,
       e.d AS folded_root, e.d = root.root AS verified
FROM placed p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang JOIN ends e USING (r)
LEFT JOIN whole w USING (r), root
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, one tree for each language; where 3 divides
    the id's CRC-32, the version with the text's A-Z in lower case."""
    docs = load(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
                      document_leaf(F.translate("text", UPPER, LOWER)))
    return manifest(docs, document_leaf(F.col("text")), tampered).drop("copied")
