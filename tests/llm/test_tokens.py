"""Encoding: chunks equal whole texts, ids equal another library's, decoding round trip."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import tokens

PATH = os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as f:
        return f.read()


def whole(text, data):
    return tokens._encoder("byte_bpe_50k", data).encode_ordinary(text)


def chunked(text, data, chunk, overlap):
    return [i for w in tokens.windows(text, chunk, overlap) for i in whole(tokens.piece(w[1], w[0], w[2], w[3]), data)]


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab'sl  \n\t\r.,19é漢 　\x1c🙂_"), max_size=120), chunk=st.integers(1, 20), overlap=st.integers(1, 8))
def test_chunks_equal_whole(text, chunk, overlap):
    with open(PATH, "rb") as f:
        data = f.read()
    pieces = [tokens.piece(w[1], w[0], w[2], w[3]) for w in tokens.windows(text, chunk, overlap)]
    assert "".join(pieces) == text
    assert chunked(text, data, chunk, overlap) == whole(text, data)
    assert tokens.decode(whole(text, data), data) == text


def test_equal_to_another_library(data):
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer.from_file(os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ["Hello world's  end\n\n x", "<|endoftext|> é漢字 ​­ 12,345.678", "def f():\n\treturn 'a'  \r\n", "ﬁ ½ ™ 🙂"]:
        assert whole(text, data) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("spread", [1, 100])
def test_rows(spark, data, spread):
    r = random.Random(1)
    long = " ".join(r.choice(["alpha", "it's", "x" * 40, "\n", "漢字", "12"]) for _ in range(900))
    rows = [(1, None), (2, ""), (3, "<|endoftext|> a"), (4, long), (4, long), (5, "y" * 5000), (None, "a b"), (6, long + " z")]
    df = spark.createDataFrame([(*x, [1], 7) for x in rows], "doc_id long, text string, ids array<int>, k int")
    got = sorted(((x.doc_id or 0, list(x.ids)) for x in tokens.encode_corpus(df, chunk=700, overlap=16, spread_chunks=spread).collect()))
    assert got == sorted((i or 0, whole(t or "", data)) for i, t in rows)
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_windows_of_a_text_without_blanks_are_linear(data):
    r = random.Random(2)
    text = "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=10_000_000))
    for t in (text, "a b " + text, text[:100_000] + " " + text[:200_000] + "\n" + text[:50_000] + "\n\n\n" + text[:20_000]):
        assert sum(len(w[1]) for w in tokens.windows(t)) <= 2.2 * len(t) + 10_000
        assert "".join(tokens.piece(w[1], w[0], w[2], w[3]) for w in tokens.windows(t)) == t
    assert chunked(text[:300_000] + " end", data, 4096, 256) == whole(text[:300_000] + " end", data)


def test_joined_documents_equal_whole_encoding(spark, data):
    from sextant.llm import queries

    d = "/root/testdata/sf0.01"
    got = {r.part: list(r.ids) for r in queries.p8_joined(spark, d).collect()}
    parts = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        parts.setdefault(r.doc_id // queries.JOINED, []).append(r.text or "")
    assert max(len("\n".join(t)) for t in parts.values()) > 262_144
    assert got == {k: whole("\n".join(t), data) for k, t in parts.items()}
