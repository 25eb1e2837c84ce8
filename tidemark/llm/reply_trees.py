"""Chat formatting over reply trees, in DataFrame operations only.

A tree is a table of messages with the id of the message they answer.
Iterative self-joins with doubling find each message's depth and summed
score (round k joins a message to the ancestor 2^k steps up), so the number
of rounds is the logarithm of the depth.  A leaf's branch is scored by the
mean score of its messages; the best branches of a tree are chosen, walked
back to the root by the same jumps, and formatted as one conversation each.

Format of a turn: ``<s>`` role ``[/INST]`` text ``</s>``, where the marks are
the control strings of the template.  Inside roles and texts every ``\\`` is
written ``\\\\``, ``<`` is ``\\l``, ``[`` is ``\\b``, so no control string can
appear there and the writing is reversed exactly.  ``parse`` reads the
formatted text back.

Defined results: NULL role or text is empty; a message whose parent is
missing is a root; equal scores are resolved by the smaller leaf id; rows
that repeat a message's id keep one of them, the smallest by role and text;
a parent chain that closes on itself has no root and belongs to no branch.
The messages of one conversation end in one formatted value, as the result
asks; nothing else is gathered by tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage_path, drop_table

from .registry import load, query

TURN_OPEN, TEXT_OPEN, TURN_CLOSE = "<s>", "[INST]", "</s>"


def escape(text: Column) -> Column:
    """``text`` without any ``<`` or ``[``, reversibly."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """Reverses ``escape``: the pieces between doubled backslashes are mended
    one by one."""
    pieces = F.split(text, r"\\\\")
    mended = F.transform(pieces, lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")),
                                                     F.lit("\\b"), F.lit("[")))
    return F.array_join(mended, "\\")


def write_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_OPEN), escape(role), F.lit(TEXT_OPEN), escape(text),
                    F.lit(TURN_CLOSE))


def parse(formatted: Column) -> Column:
    """Array of ``role`` and ``text`` of a formatted conversation."""
    turns = F.slice(F.split(formatted, TURN_CLOSE), 1, F.greatest(
        F.size(F.split(formatted, TURN_CLOSE)) - 1, F.lit(0)))

    def turn(x):
        halves = F.split(F.substr(x, F.lit(len(TURN_OPEN) + 1)), r"\[INST\]")
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))
    return F.transform(turns, turn)


def _jumps(nodes: DataFrame):
    """Tables (``id``, ``up``) of the ancestors 1, 2, 4, ... steps up, and the
    messages that reach a root with ``root``, ``depth`` and ``total``."""
    spark = nodes.sparkSession
    known = nodes.select(F.col("id").alias("up"))
    jump = nodes.select("id", F.col("parent").alias("up")).join(known, "up", "left_semi")
    jump, path = cut_lineage_path(jump.select("id", "up"))
    paths, levels = [path], [jump]
    state, state_path = cut_lineage_path(
        nodes.select("id", "score").join(jump, "id", "left")
        .select("id", "up", F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"),
                F.when(F.col("up").isNull(), F.col("id")).alias("root")))
    left = state.filter("root IS NULL").count()
    while left:
        # a message that has not reached a root adds what its ancestor knows;
        # the others have nothing to join
        far = state.select(F.col("id").alias("up"), F.col("up").alias("next"),
                           F.col("steps").alias("more"), F.col("total").alias("extra"),
                           F.col("root").alias("top"))
        new = (state.filter("root IS NULL").join(far, "up")
               .select("id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"),
                       (F.col("total") + F.col("extra")).alias("total"), F.col("top").alias("root"))
               .unionByName(state.filter("root IS NOT NULL")))
        new, new_path = cut_lineage_path(new)
        drop_table(spark, state_path)
        state, state_path = new, new_path
        longer = levels[-1].select("id", F.col("up").alias("mid")).join(
            levels[-1].select(F.col("id").alias("mid"), "up"), "mid").select("id", "up")
        longer, path = cut_lineage_path(longer)
        paths.append(path)
        levels.append(longer)
        before, left = left, state.filter("root IS NULL").count()
        if left == before:  # only chains that close on themselves are left
            break
    paths.append(state_path)
    return levels, state.filter("root IS NOT NULL"), paths


def branches(messages: DataFrame, best: int = 1, id_col: str = "id", parent_col: str = "parent",
             tree_col: str = "tree", role_col: str = "role", text_col: str = "text",
             score_col: str | None = "score") -> DataFrame:
    """The ``best`` branches of every tree, formatted: ``tree``, ``branch``
    (rank from 1), ``leaf``, ``score``, ``n_turns`` and ``formatted``."""
    empty = F.lit("")
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    nodes = messages.select(
        F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(tree_col).alias("tree"),
        F.coalesce(F.col(role_col), empty).alias("role"),
        F.coalesce(F.col(text_col), empty).alias("text"), score.alias("score"))
    nodes = (nodes.filter("id IS NOT NULL").groupBy("id")
             .agg(F.min(F.struct("role", "text", "parent", "tree", "score")).alias("m"))
             .select("id", "m.*"))
    nodes, nodes_path = cut_lineage_path(nodes)
    levels, reached, paths = _jumps(nodes.select("id", "parent", "score"))

    answered = nodes.select(F.col("parent").alias("id")).distinct()
    leaves = (reached.join(answered, "id", "left_anti")
              .select("id", "root", F.col("steps").alias("n_turns"),
                      (F.col("total") / F.col("steps")).alias("score")))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "id"))
    chosen = leaves.withColumn("branch", rank).filter(F.col("branch") <= best)
    chosen, path = cut_lineage_path(chosen)
    paths.append(path)
    # back to the root: after the jump of 2^k every branch holds 2^(k+1) messages
    # (each round is written, as it would otherwise stand twice in the next one's plan)
    walk = chosen.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("back"))
    for k, jump in enumerate(levels):
        further = (walk.join(jump, "id")
                   .select("leaf", F.col("up").alias("id"),
                           (F.col("back") + F.lit(1 << k)).alias("back")))
        further, path = cut_lineage_path(further)
        paths.append(path)
        walk = walk.unionByName(further)
    turns = (walk.join(nodes.select("id", "role", "text"), "id")
             .withColumn("turn", write_turn(F.col("role"), F.col("text"))))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "turn")))
    text = F.array_join(F.transform(ordered, lambda x: x["turn"]), "")
    told = turns.groupBy("leaf").agg(text.alias("formatted"))
    out = (told.join(chosen.withColumnRenamed("id", "leaf"), "leaf")
           .join(nodes.select(F.col("id").alias("root"), "tree"), "root")
           .select("tree", "branch", "leaf", "score", "n_turns", "formatted"))
    out, _ = cut_lineage_path(out)
    for p in [nodes_path, *paths]:
        drop_table(messages.sparkSession, p)
    return out


def linear_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                    role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as trees: each turn answers the one before it.

    The order inside a conversation is (turn, role, text); repeated rows are
    turns of their own.  Neighbours are found by a running number.
    """
    order = Window.partitionBy("tree").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(),
        F.col("text").asc_nulls_first())
    rows = turns.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("at", F.row_number().over(order))
    return rows.select("tree", "role", "text", F.struct("tree", "at").alias("id"),
                       F.when(F.col("at") > 1, F.struct("tree", (F.col("at") - 1).alias("at")))
                       .alias("parent"), F.length("text").cast("double").alias("score"))


PROBE = "</s>[INST] ok [/INST]"


def _sql_escaped_length(x: str) -> str:
    return "+".join([f"3 * length({x})"] + [
        f"-length(replace({x}, '{c}', ''))" for c in ("\\", "<", "[")]) .replace("+-", "-")


OP5_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
                            text NULLS FIRST) AS place
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{PROBE}'
        UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS told,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum({len(TURN_OPEN) + len(TEXT_OPEN) + len(TURN_CLOSE)}
             + length(role) + {_sql_escaped_length('role')}
             + length(text) + {_sql_escaped_length('text')}) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM c"""


@query("op5_reply_trees", OP5_SQL)
def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    turns = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(PROBE).alias("text"))
    told = branches(linear_messages(turns.unionByName(probe)))
    back = told.withColumn("turns", parse(F.col("formatted")))
    joined = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"),
                                    lambda t: t["text"]), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(joined, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
