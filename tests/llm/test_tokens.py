import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from loanlab.llm import byte_bpe, catalog, token_counts

PATTERN = public_tokenizers.PATTERN
SIGNS = list(" \n\t\x1c\x85\xa0\u200babcXYZ'séßñ12٣.,!?<|>日本語🙂") + ["'re", "<|endoftext|>", "  ", " \n"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    out = ["", " ", "a", "  a  b \n\n c ", "a" * 3000, "".join(rng.choices("abcdeaeioust", k=20_000)), "the " * 500]
    return out + ["".join(rng.choices(SIGNS, k=rng.randint(0, 40))) for _ in range(1500)]


def test_encoder_equals_the_library(ranks, library):
    encoder = byte_bpe.Encoder(ranks, PATTERN)
    for text in texts():
        packed = encoder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text), repr(text[:60])
        assert encoder.decode(packed) == text.encode()


def test_query_equals_the_library(spark, sf, library):
    rows = {r.doc_id: r for r in catalog.op2(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = np.array(library.encode_ordinary(d.text), "<u4").tobytes()
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())


def test_odd_rows_encode(odd_docs, no_docs, ranks):
    rows = byte_bpe.encode(odd_docs, ranks, PATTERN, keep=("doc_id", "text", "score", "n tokens.x"))
    assert rows.columns == ["doc_id", "text", "score", "n tokens.x", "ids"]
    back = byte_bpe.decode(rows, ranks, PATTERN, keep=("doc_id", "text")).collect()
    assert len(back) == 10 and all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert byte_bpe.encode_and_decode(no_docs, ranks, PATTERN).count() == 0


def test_counts_equal_the_library(spark, sf, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    counter = token_counts.Counter(token_counts.Model(path), PATTERN)
    for text in texts() + ["a<|endoftext|>b", "<|endoftext|><|endoftext|>"]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text[:60])
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalog.op7(spark, sf).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)
    odd = token_counts.count_tokens(odd_docs, path, PATTERN, keep=("doc_id", "text")).collect()
    assert len(odd) == 10 and all(r.n_tokens == 0 == r.n_bytes for r in odd if not r.text)
    assert token_counts.count_tokens(no_docs, path, PATTERN).count() == 0


def test_whole_tokens_are_proven():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, library = token_counts.Model(path), Tokenizer.from_file(path)
    some = sorted(model.whole)[::500]
    assert len(model.whole) > 40_000
    # each is one token when it stands alone as a pre-token
    assert all(len(token_counts.merged(library.model.id_to_token(library.token_to_id(t)), model.merges)) == 1
               for t in some if library.token_to_id(t) is not None)
