"""BPE against the tokenizers library, on odd texts and on random ones."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm.bpe import Encoder, WordBpe, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "Hello  wörld's <|endoftext|> 42x Σς <|ENDOFTEXT|> tab\there ...a", "x<|startoftext|>y", "aaa aaaa aaaaa",
       "it's a 'test's 日本語👍🏽 é Å", "a\x1cb \x85c\xa0d", "é İI ŉ ﬁ", "ab" * 3000, "\n\n", "don't WE'LL", "ΑΣ ΑΣΑ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(WordBpe(open(PATH, encoding="utf-8").read()))


def ids(encoder, texts):
    import numpy as np

    return [np.frombuffer(b, "<i4").tolist() for b in encoder.encode(texts)]


def test_odd_texts(encoder, library):
    assert ids(encoder, ODD) == [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aabbcdeinorstth ' <|>\nΣÉé9"), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=60))
def test_random_texts(encoder, library, text):
    assert ids(encoder, [text]) == [library.encode(text, add_special_tokens=False).ids]


def test_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "x"), (1, "twice", "y"), (1, "twice", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in encode_decode(docs, PATH).collect())
    want = []
    for i, t, _ in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), e, library.decode(e, skip_special_tokens=False)))
    assert got == sorted(want)
    assert encode_decode(docs.limit(0), PATH).count() == 0
