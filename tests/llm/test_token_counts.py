import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import token_counts as tc

SP = sentencepiece.SentencePieceProcessor(model_file=tc.default_model())
LENGTHS = tc.Lengths(tc.PieceModel(tc.default_model()), {}, cache_size=5)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abthe  \n\t▁é😀. 　\x00<>s/1"), max_size=60))
def test_sum_of_pre_tokens(text):
    assert LENGTHS.count(text) == len(SP.encode(text))


def test_rows(edge_docs, no_docs):
    got = sorted(map(tuple, tc.count_tokens(edge_docs, tc.default_model(), table_size=10).collect()),
                 key=str)
    want = [(r.doc_id, len((r.text or "").encode()), len(SP.encode(r.text or "")))
            for r in edge_docs.select("doc_id", "text").collect()]
    assert got == sorted(want, key=str)
    assert tc.count_tokens(no_docs, tc.default_model()).count() == 0


def test_table_is_bounded(edge_docs):
    table = tc.frequent_lengths(edge_docs, tc.default_model(), table_size=7, task_top=5, task_keep=20)
    assert 0 < len(table) <= 7
    assert all(n == len(SP.encode(w)) for w, n in table.items())
