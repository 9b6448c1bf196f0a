import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bibspark.llm import encode

pytestmark = pytest.mark.skipif(not os.path.isdir(encode.TOKENIZER_DIR), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def ranks():
    return encode.read_ranks(os.path.join(encode.TOKENIZER_DIR, encode.VOCABULARY))


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("test", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return encode.Encoder(ranks)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=120))
def test_any_text(encoder, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.encode_batch([text])[0].tolist() == reference.encode_ordinary(text)


def test_made_up_words(encoder, reference):
    rng = random.Random(1)
    texts = ["".join(rng.choice("etaoinshrdlucé ZQ'9_\n") for _ in range(rng.randrange(1, 400))) for _ in range(400)]
    texts += ["a" * 3000, "ab" * 5000, "xyz" * 1000, "<|endoftext|>", " \n \n\n x", "日本語" * 200, "\x00\x01"]
    got = encoder.encode_batch(texts)
    assert all(g.tolist() == reference.encode_ordinary(t) for g, t in zip(got, texts))
    assert 0 < encoder.merged < encoder.speculated  # most words pass the check, some need merging
    decoded = b"".join(encoder.tokens[i] for i in got[0].tolist()).decode()
    assert decoded == texts[0]


def test_merging_is_one_thing(encoder):
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choice(b"aeinrst hel\xc3\xa9") for _ in range(rng.randrange(60, 140)))
        assert encoder.merge_long(data) == encoder.merge(data)


def test_column(spark, reference):
    rows = [(1, "Hello there", "x"), (2, None, "y"), (3, "", "z"), (4, "Hello there", None), (5, "word " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_column(df, "doc_id", "text").collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t, _ in rows}
    out = encode.encode_column(df.limit(0), "doc_id", "text")
    assert out.count() == 0 and dict(out.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
