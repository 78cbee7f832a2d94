import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from wardline.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no tokenizer here")


@pytest.fixture(scope="module")
def encode():
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab12 \n\t\r,.'ñ漢👩 　|-"), max_size=60))
def test_counts_are_exact(encode, text):
    assert tokens.counter()(text) == len(encode(text))


def test_column(spark):
    df = spark.createDataFrame([(1, "Two words", "x"), (2, "", "x"), (3, None, "x")], "doc_id int, text string, n_tokens string")
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.with_tokens(df).collect()) == [(1, 2), (2, 0)]
