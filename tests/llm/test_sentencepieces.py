"""Encoding and decoding against the library."""

from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import sentencepieces as P

parts = st.sampled_from([" ", "  ", "\n", "\t", "a", "The", "é", "▁", "日", "😀", "<s>", "<0x41>", "token", "\x00", "   ", "xylo" * 20, "\n\n", "\r", "ing", ",", "."])


@pytest.fixture(scope="module")
def words():
    return P.vocabulary(P.default_model())


@settings(deadline=None, max_examples=400)
@given(st.lists(parts, max_size=14).map("".join))
def test_texts(words, text):
    ids = words.encode(text)
    words.check()
    assert ids == words.library.encode(text)
    assert words.decode(ids) == words.library.decode(ids)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_any_ids_decode(words, ids):
    if words.library.unk_id() not in ids:
        assert words.decode(ids).lstrip(" ") == words.library.decode(ids).lstrip(" ")


def test_both_agendas_agree(words):
    for text in ("▁internationalization", "▁" + "ab" * 19, "▁aaaaaaaaaaaa", "▁日本語éè"):
        assert words._short(text) == words._long(text)


def test_long_text(words):
    text = "lorem ipsum " * 20_000 + "x" * 3000
    assert words.encode(text) == words.library.encode(text)


def test_a_difference_is_an_error(words):
    words.encode("brandnewchunk")
    words.chunks.new["brandnewchunk"][0] += 1
    with pytest.raises(ValueError, match="another way"):
        words.check()
    words.chunks.clear()


def test_memory_is_bounded_by_bytes(words, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 100_000)
    text = "\n".join("".join(chr(0x4E00 + (i * 7 + j * j) % 9000) for j in range(1000)) for i in range(60))  # lines without blanks
    for piece in (text, " ".join(f"w{i}x" for i in range(3000))):
        assert words.encode(piece) == words.library.encode(piece)
        words.check()
        chunks = words.chunks
        assert sum(P.ENTRY + 4 * (len(k) + len(v)) for part in (chunks, chunks.old) for k, v in part.items()) < 1_500_000
        assert all(len(k) <= P.LONGEST for k in chunks) and not chunks.new
    words.chunks.clear()


def test_vocabularies_without_boundaries_are_read_whole(words, monkeypatch):
    monkeypatch.setattr(words, "chunked", False)
    assert words.encode("two  words\nhere") == words.library.encode("two  words\nhere") and words.encode("") == []


def test_frame(spark, words):
    rows = [(1, "Hello  world\n", 5), (None, None, None), (2, "", 1), (1, "Hello  world\n", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = P.encode_decode(docs).collect()
    assert len(out) == 4 and out[0].decoded == "Hello  world\n" and out[0].ids == words.library.encode("Hello  world\n")
    assert [(r.ids, r.decoded) for r in out[1:3]] == [([], ""), ([], "")]
    assert P.encode_decode(docs.limit(0)).count() == 0
    slim = P.encode_decode(docs, keep_text=False)
    assert slim.columns == ["doc_id", "ids", "has_text"] and [(r.ids, r.has_text) for r in slim.collect()] == [(r.ids, r.decoded != "") for r in out]


def test_query_digests(spark, words):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in P.op8_sentencepiece(spark, sf_dir).collect():
        ids = words.library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256(words.library.decode(ids).encode()).hexdigest()
