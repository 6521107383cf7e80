import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.tokenizer import FOLDER, PATTERN, encode_documents, load

PATH = f"{FOLDER}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="vocabulary files aren't here")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(t=st.one_of(st.text(), st.text(alphabet="ab c'\nهلا 12é.", max_size=200)))
@settings(max_examples=300, deadline=None)
def test_equals_the_library(reference, t):
    if not any("\ud800" <= c <= "\udfff" for c in t):
        assert load(PATH).encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_long_words(reference):
    import random

    rng = random.Random(1)
    for t in ("a" * 3000, "ab" * 2000, " " * 50_000 + "x", "".join(rng.choice("abcdeihnrst") for _ in range(20_000)), "".join(rng.choice("الملوي") for _ in range(5000)), "=" * 4000):
        assert load(PATH).encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_operator(spark, reference):
    texts = [None, "", "Hello  world", "a" * 5000, "<|endoftext|>", "كان يا ما كان", "Hello  world"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode_documents(df).collect()}
    assert got == {i: None if t is None else reference.encode_ordinary(t) for i, t in enumerate(texts)}
    assert encode_documents(df.limit(0)).collect() == []
