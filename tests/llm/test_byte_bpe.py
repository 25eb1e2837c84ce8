import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe

RANKS, PATTERN = byte_bpe.default_ranks()
SMALL = byte_bpe.TreeCodec(RANKS, PATTERN, leaf_chars=3, leaf_tokens=2, window=1)


def plain(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(
        "byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PLAIN = plain(None)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab' \n\tsl1é😀. 　\x1c\x85x"), max_size=60))
def test_tree_equals_whole_text(text):
    ids = SMALL.encode(text)
    assert ids.tolist() == PLAIN.encode_ordinary(text)
    assert SMALL.decode(ids) == text.encode()


def test_rows(edge_docs, no_docs):
    got = sorted(map(tuple, byte_bpe.digests(edge_docs, RANKS, PATTERN).collect()), key=str)
    want = []
    for r in edge_docs.select("doc_id", "text").collect():
        ids = PLAIN.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.digests(no_docs, RANKS, PATTERN).count() == 0


def test_unpack(spark, edge_docs):
    enc = byte_bpe.encode(edge_docs.filter("doc_id = 9"), RANKS, PATTERN)
    row = enc.select(byte_bpe.unpack_ids(enc.ids).alias("x"), "ids").first()
    assert row.x == np.frombuffer(row.ids, "<u4").tolist()


def test_encode_and_decode_share_one_worker(edge_docs):
    plan = byte_bpe.digests(edge_docs, RANKS, PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    both = byte_bpe.decode(byte_bpe.encode(edge_docs, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(map(tuple, byte_bpe.encode_decode(edge_docs, RANKS, PATTERN).collect()), key=str) == sorted(
        map(tuple, both.collect()), key=str)
