import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from text_rows import prose

from tidemark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, pos long, n int, leaf string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def doc_leaf(r, text):
    return H(*[field(v) for v in (r[0], r[3], r[2], r[4], text)])


def levels_of(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def sides(levels, pos):
    out = []
    for level in levels[:-1]:
        run = level[pos // 8 * 8:pos // 8 * 8 + 8]
        out.append((run[:pos % 8], run[pos % 8 + 1:]))
        pos //= 8
    return out


def lower(t):
    return t.translate(str.maketrans(merkle.UPPER, merkle.LOWER))


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    mine = {x: sorted([r for r in rows if r[2] == x],
                      key=lambda r: (r[0] is not None, r[0] or 0, doc_leaf(r, r[1]))) for x in langs}
    trees = {x: levels_of([doc_leaf(r, r[1]) for r in mine[x]]) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for t, x in enumerate(langs):
        for pos, r in enumerate(mine[x]):
            path = sides(trees[x], pos) + sides(top, t)
            now = trees[x][0][pos]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = doc_leaf(r, lower(r[1]))
            for b, a in path:
                now = H(*b, now, *a)
            out.append((r[0], trees[x][0][pos], trees[x][-1][0], top[-1][0],
                        H(*[d for b, a in path for d in b + a]), now, now == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n):
    rows = []
    for i in range(n):
        lang = [None, "de", "en", "en", "en", "é", "zz"][i % 7] if i % 11 else "lone" if i == 0 else "en"
        rows.append((i, None if i % 13 == 5 else "" if i % 13 == 6 else f"Text {prose(i, 5)} ABC\né",
                     lang, None if i % 5 == 0 else f"src{i % 3}", None if i % 4 == 0 else i, "x", 3, 4, "l"))
    rows += [*rows[2:4], *rows[2:3], (None, None, None, None, None, None, None, None, None),
             (None, "Same Id", "en", "s", 1, "x", 1, 1, "x"), (3, "Other Text", "en", "s", 1, "x", 1, 1, "x")]
    return rows


def result(spark, rows, levels):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    bad = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
                 merkle.document_leaf(F.translate("text", merkle.UPPER, merkle.LOWER)))
    return merkle.manifest(docs, merkle.document_leaf(F.col("text")), bad, levels=levels)


@pytest.mark.parametrize("n, levels", [(1, 4), (60, 1), (300, 1), (300, 2), (300, 4)])
def test_against_brute_force(spark, n, levels):
    rows = rows_of(n)
    got = sorted((tuple(r) for r in result(spark, rows, levels).drop("copied").collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert result(spark, [], 4).count() == 0


def test_lone_leaf(spark):
    r = result(spark, [(1, "A", "en", "s", 1, "x", 1, 1, "x")], 4).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H()


def test_versions_copy_ancestors_only(spark):
    rows = rows_of(300)
    for r in result(spark, rows, 2).collect():
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        assert (r.copied is not None) == tampered
        if tampered:
            assert r.copied[-1] == r.folded_root and len(r.copied) <= 8


def test_shared_nodes():
    old = merkle.build([H(str(i)) for i in range(70)], 3)
    new = old.replaced(3, 9, H("other"))
    assert new.children[1:] == old.children[1:] and new.children[0] is not old.children[0]
    kept = [a is b for a, b in zip(new.children[0].children, old.children[0].children, strict=True)]
    assert kept == [True, False] + [True] * 6
    assert old.digest == levels_of([H(str(i)) for i in range(70)])[-1][0] != new.digest
