import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import byte_bpe, queries

ENCODER = byte_bpe.encoder(byte_bpe.default_vocabulary())
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(ENCODER.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_like_the_library(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)
    assert ENCODER.decode(ENCODER.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeionrsth éüñ\n", max_size=200))
def test_word_like_text_like_the_library(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_long_pieces_and_a_small_memo(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 3)
    small = byte_bpe.Encoder(byte_bpe.default_vocabulary())
    for text in ("ab" * 30000, "x" * 20001, " " * 5000, "the cat and the dog and the cat " * 50, "<|endoftext|>"):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_every_token_stands_for_itself():
    for rank in range(0, len(ENCODER.tokens), 97):
        assert ENCODER.merged(ENCODER.tokens[rank]) == [rank]


def test_columns(odd_docs, no_docs):
    both = odd_docs.select("text", byte_bpe.encode_decode(F.col("text")).alias("bpe"), byte_bpe.encode(F.col("text")).alias("ids"))
    for r in both.withColumn("plain", byte_bpe.decode(F.col("ids"))).collect():
        assert bytes(r.bpe.ids) == bytes(r.ids) == np.array(REFERENCE.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert bytes(r.bpe.decoded) == bytes(r.plain) == (r.text or "").encode()
    assert no_docs.select(byte_bpe.encode(F.col("text")).alias("ids")).collect() == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op4_byte_bpe"](spark, sf_dir).collect():
        want = REFERENCE.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
