import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row

from tallymart.llm import bpe
from tallymart.llm.common import table

WORDS = bpe.vocabulary_of()


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(WORDS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(WORDS), special_tokens={})


@pytest.mark.parametrize("text", ["", " ", "a", "don't", "  x \n\n y", "a" * 5000, "ab" * 3000, "\x00\x01", "日本語 🙂 é", "the" * 999, "<|endoftext|>"])
def test_same_ids_and_round_trip(ours, theirs, text):
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


def test_random_texts(ours, theirs):
    r = random.Random(5)
    for _ in range(2000):
        text = "".join(r.choice("abcdeiou  éñ中🙂\n\t12's.,AZ") for _ in range(r.randint(0, 60)))
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_small_memos_change_nothing(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    monkeypatch.setattr(bpe, "MAX_PARTS", 2)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 3)
    e = bpe.Encoder(WORDS, public_tokenizers.PATTERN)
    text = "Then edinth is thndor thonndon ernd reer thor edtionnt to nd sting antilyou erer " * 3
    assert e.encode(text) == theirs.encode_ordinary(text)


def test_query_against_the_library(spark, sf, theirs):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = bpe.op3_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_and_clashes(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text=None, token="x"), Row(doc_id=None, text="a b", token=None), Row(doc_id=2, text="", token="y"), Row(doc_id=2, text="", token="y")], "doc_id long, text string, token string")
    got = {(r.doc_id, r.n_tokens) for r in bpe.digest(docs).collect()}
    assert got == {(1, 0), (None, 2), (2, 0)}
    assert bpe.digest(docs).count() == 4
    assert bpe.digest(docs.limit(0)).count() == 0
    kept = bpe.encode(docs)
    assert kept.columns == ["doc_id", "text", "token", "ids"]


def test_taken_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 7)], "doc_id long, text string, IDS string, decoded int")
    twice = bpe.decode(bpe.encode(docs), "ids_")
    for got in (twice, bpe.round_trip(docs)):
        assert got.columns == ["doc_id", "text", "IDS", "decoded", "ids_", "decoded_"]
        r = got.first()
        assert (r.IDS, r.decoded, r.decoded_) == ("mine", 7, b"a b") and len(r.ids_) == 2


def test_white_space_of_all_kinds(ours, theirs):
    r = random.Random(9)
    for _ in range(4000):
        text = "".join(r.choice(["a", "b1", ".", " ", " ", "\n", "\t", "\x85", "\xa0", "\u3000", "\x1c", "'s"]) for _ in range(r.randint(0, 14)))
        assert ours.encode(text) == theirs.encode_ordinary(text), repr(text)
