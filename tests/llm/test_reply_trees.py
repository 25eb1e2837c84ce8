import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import reply_trees as rt


def esc(x):
    return (x or "").replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def test_escapes_round_trip(spark):
    strange = ["", "\\", "\\\\", "\\l", "\\b", "<", "[", "<s>[INST]</s>", "\\<", "<\\", "\\\\l", "a\\",
               rt.PROBE, "\n\n", "é😀", "\\\\\\[", "[INST]</s><s>user"]
    found = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("\\<[lbs/]\n>I"), max_size=12))
    def more(text):
        found.append(text)
    more()
    df = spark.createDataFrame([(x,) for x in strange + found], "t string")
    back = df.select("t", rt.escape(F.col("t")).alias("e")).select(
        "t", "e", rt.unescape(F.col("e")).alias("u"),
        rt.parse(rt.write_turn(F.col("t"), F.col("t"))).alias("p")).collect()
    for r in back:
        assert r.e == esc(r.t) and r.u == r.t and not set("<[") & set(r.e)
        assert [tuple(x) for x in r.p] == [(r.t, r.t)]


def brute_paths(rows, best):
    """rows: (id, parent, tree, role, text, score)."""
    nodes = {r[0]: r for r in sorted(rows, key=str, reverse=True)}
    answered = {r[1] for r in nodes.values()}
    out = {}
    for r in nodes.values():
        if r[0] in answered:
            continue
        path, x = [r], r
        while x[1] in nodes and len(path) <= len(nodes):
            x = nodes[x[1]]
            path.append(x)
        if len(path) > len(nodes):
            continue
        out.setdefault(x[0], []).append((-sum(p[5] or 0 for p in path) / len(path), r[0], path[::-1]))
    return sorted((nodes[root][2], k + 1, leaf, len(path),
                   "".join(f"<s>{esc(p[3])}[INST]{esc(p[4])}</s>" for p in path))
                  for root, all_ in out.items() for k, (_, leaf, path) in enumerate(sorted(all_)[:best]))


def test_branches(spark):
    rows = [(1, None, 10, "user", "hi", 1.0), (2, 1, 10, "assistant", "a", 0.5),
            (3, 1, 10, "assistant", "b", 2.0), (4, 2, 10, "user", "c", 9.0), (5, 3, 10, "user", None, 0.0),
            (6, 3, 10, "user", "[INST]", 0.0), (7, 99, 11, "user", "lost parent", 1.0),
            (8, 9, 12, "user", "ring", 1.0), (9, 8, 12, "user", "ring", 1.0),
            (20, 9, 12, "user", "hangs on a ring", 1.0), (21, None, 13, None, "", None)]
    rows += [(100 + i, 99 + i if i else None, 14, "user" if i % 2 else "assistant", f"t{i}", 1.0)
             for i in range(37)]
    df = spark.createDataFrame(rows, "id long, parent long, tree long, role string, text string, score double")
    for best in (1, 5):
        got = sorted((r.tree, r.branch, r.leaf, r.n_turns, r.formatted)
                     for r in rt.branches(df, best).collect())
        assert got == brute_paths(rows, best)
    assert rt.branches(df.limit(0)).count() == 0
    twice = df.unionByName(df)
    assert rt.branches(twice, 5).count() == rt.branches(df, 5).count()


def test_query_on_edge_conversations(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a</s>"), (1, 2, "assistant", "b\\l"),
            (1, 2, "assistant", "b\\l"), (2, 5, None, None), (2, None, "assistant", ""),
            (3, 1, "assistant", "two"), (3, 0, "user", "one"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.withColumn("id", F.lit(1)).withColumn("tree", F.lit("t")).write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in rt.op5_reply_trees(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, None, -1}
    rows += [(-1, 0, "user", rt.PROBE), (-1, 1, "assistant", rt.PROBE)]
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, a is not None, a or "", x or "")
                        for c, t, a, x in rows if c == conv))
        told = "".join(f"{a}\n{x}\n" for _, _, _, a, x in turns)
        loss = "".join(x for _, _, _, a, x in turns if a == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(13 + len(esc(a)) + len(esc(x)) for _, _, _, a, x in turns)


def test_native_plan(spark):
    plan = rt.op5_reply_trees(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    assert not re.search("Python|Pandas|Arrow", plan.toString())
