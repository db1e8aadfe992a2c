import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as format_of

from loanlab.llm import catalog, piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = list(" \n\t\x00\x1c\x85\xa0​abcXYZ'séßñ12٣.,!?<|>日本語🙂▁ａ①½ﬁ　¨") + [
    "  ", "   ", " the", " of", "▁▁", "<s>", "</s>", "<0x0A>", "tion", "ing ", "é", "한국", "한"]


def variant(**changes) -> bytes:
    """The model file with other settings."""
    spec = format_of.ModelProto()
    with open(PATH, "rb") as f:
        spec.ParseFromString(f.read())
    if changes.pop("no_bytes", False):
        spec.trainer_spec.byte_fallback = False
        for piece in spec.pieces:
            if piece.type == piece_bpe.BYTE:
                piece.type, piece.score = piece_bpe.NORMAL, -1e8
    if rule := changes.pop("rule", None):
        made = format_of.ModelProto()
        made.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        spec.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    for name, value in changes.items():
        setattr(spec.normalizer_spec, name, value)
    return spec.SerializeToString()


MODELS = {"as it is": {}, "map": {"rule": "nmt_nfkc"}, "case map": {"rule": "nfkc_cf"},
          "map, tidy": {"rule": "nmt_nfkc", "remove_extra_whitespaces": True}, "tidy": {"remove_extra_whitespaces": True},
          "no prefix": {"add_dummy_prefix": False}, "no bytes": {"no_bytes": True}, "no escape": {"escape_whitespaces": False}}


def texts(n):
    rng = random.Random(11)
    out = ["", " ", "  ", "a", " a", "a ", "  a  b \n\n c ", "a" * 3000, "▁", "▁a", "a▁ b", "the " * 300, " " * 500,
           "".join(rng.choices("abcdeaeioust", k=5000))]
    return out + ["".join(rng.choices(SIGNS, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", MODELS)
def test_ids_spans_and_decoding_equal_the_library(name):
    blob = variant(**MODELS[name])
    library = sentencepiece.SentencePieceProcessor(model_proto=blob)
    encoder = piece_bpe.Encoder(piece_bpe.Model(blob))
    for text in texts(700):
        ids, ends = encoder.encode(text)
        want = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces], repr(text)
        assert ends.tolist() == [p.end for p in want.pieces], repr(text)
        begins = [p.begin for p in want.pieces]
        assert begins[1:] == ends.tolist()[:-1]
        assert encoder.decode(ids) == library.decode(ids.tolist()), repr(text)


@pytest.mark.parametrize("name", ["as it is", "tidy", "no prefix"])
def test_any_ids_decode_as_by_the_library(name):
    blob, rng = variant(**MODELS[name]), random.Random(2)
    library = sentencepiece.SentencePieceProcessor(model_proto=blob)
    encoder = piece_bpe.Encoder(piece_bpe.Model(blob))
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(262), 0, 1, 2, 259]) for _ in range(rng.randint(0, 8))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_both_merges_agree():
    model, rng = piece_bpe.read_model(PATH), random.Random(6)
    for _ in range(500):
        signs = rng.choices(list("▁▁▁aeiounrstlé,."), k=rng.randint(1, 40))
        assert [p for p, _ in piece_bpe.merge(signs, model.ranks)] == piece_bpe.merge_few(signs, model.ranks)


def test_query_equals_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalog.op13(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id] or ""
        ids = library.encode(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_source_bytes) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest(), len(text.encode()))


def test_odd_rows(spark, odd_docs, no_docs):
    model = piece_bpe.read_model(PATH)
    rows = piece_bpe.encode(odd_docs, model, keep=("doc_id", "text", "score", "n tokens.x"))
    assert rows.columns == ["doc_id", "text", "score", "n tokens.x", "ids", "ends"]
    for r in rows.collect():
        size = len((r.text or "").encode())
        assert len(r.ids) == len(r.ends) and (r.ends == [] if not size else r.ends[-1] == size)
    back = piece_bpe.decode(rows, model, keep=("doc_id", "text")).collect()
    assert len(back) == 10 and all(r.decoded == (r.text or "") for r in back)
    clash = odd_docs.withColumnRenamed("score", "ids")
    both = piece_bpe.encode_and_decode(clash, model, keep=("doc_id", "text", "ids")).collect()
    assert len(both) == 10 and all(r.decoded == (r.text or "") for r in both)
    assert piece_bpe.encode_and_decode(no_docs, model).count() == 0
    assert piece_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), model).first().decoded == ""


def test_other_models_are_refused():
    spec = format_of.ModelProto()
    spec.ParseFromString(variant())
    spec.pieces[300].type = piece_bpe.USER
    with pytest.raises(ValueError):
        piece_bpe.Model(spec.SerializeToString())


@pytest.mark.parametrize("word", ["🙂" * 5000, "zq" * 3000, "ab" + "\n" * 5000, "ж的" * 900])
def test_long_runs_that_no_piece_joins(word):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoder = piece_bpe.Encoder(piece_bpe.read_model(PATH))
    text = f"a {word} b"
    ids, ends = encoder.encode(text)
    assert ids.tolist() == library.encode(text) and ends[-1] == len(text.encode())
    assert encoder.decode(ids) == library.decode(ids.tolist())


def test_query_takes_null_and_empty_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a " + "🙂" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: (r.n_tokens, r.n_source_bytes) for r in catalog.op13(spark, str(tmp_path)).collect()}
    assert got == {i: (len(library.encode(t or "")), len((t or "").encode())) for i, t in rows}
