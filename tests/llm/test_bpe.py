import hashlib
import random

import public_tokenizers
import tiktoken

from inklattice.llm import bpe


def reference():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_tiktoken_and_round_trip():
    ranks, own = reference()
    codec = bpe.Codec(bpe.tokenizer_json(ranks), public_tokenizers.PATTERN)
    r = random.Random(3)
    chars = [*"abstre vmld'0123#$.,ABCéßñ", *map(chr, (9, 10, 13, 28, 31, 32, 39, 0x85, 0xA0, 0x2028, 0x3000, 0x200B, 0x1F600, 0x4E2D, 0x301, 0x660, 0xB2)), "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(r.choice(chars) for _ in range(r.randint(0, 40)))
        ids = codec.encode(text)
        assert ids == own.encode_ordinary(text)
        assert codec.decode(ids) == text
        spans = codec.encode_with_offsets(text)
        assert [i for i, _, _ in spans] == ids
        assert all(text[a:b] for _, a, b in spans) and (not spans or (spans[0][1], spans[-1][2]) == (0, len(text)))


def test_documents(spark):
    _, own = reference()
    texts = ["Hello  world\n\n 12", None, "", "é" * 5000 + " x" * 3000, "Hello  world\n\n 12", "😀"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_documents(docs, with_ids=True).collect()}
    for k, text in enumerate(texts):
        ids = own.encode_ordinary(text or "")
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].ids) == (len(ids), hashlib.sha256(data).hexdigest(), ids)
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs, with_ids=True)).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.encode_documents(docs.limit(0)).collect() == []


def test_split_characters():
    ranks, own = reference()
    codec = bpe.Codec(bpe.tokenizer_json(ranks), public_tokenizers.PATTERN)
    ids = codec.encode("𒀀")
    assert len(ids) > 1 and codec.decode(ids[:1]) == own.decode(ids[:1])


def test_bytes_that_are_not_utf8(spark):
    docs = spark.range(2).selectExpr("id AS doc_id", "IF(id = 0, CAST(X'61FF62C328' AS STRING), 'ok') AS text")
    row = next(r for r in bpe.encode_documents(docs, with_ids=True).collect() if r.doc_id == 0)
    assert row.decoded_sha256 == hashlib.sha256(b"a\xffb\xc3(").hexdigest() and row.n_tokens == len(row.ids) >= 3


def test_null_ids_stay(spark):
    got = bpe.encode_documents(spark.createDataFrame([(None, "a b"), (None, None), (1, "a b")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 2), ("None", 0), ("None", 2)]
