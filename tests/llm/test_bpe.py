import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from laborcast.llm.bpe import encode, vocabulary
from laborcast.llm.queries_bpe import VOCABULARY, digests

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def _ids(text):
    from array import array

    out = array("i")
    vocabulary(VOCABULARY).encode_into(text, out)
    return list(out)


def test_pieces_agree_with_the_library(tokenizer):
    rng = random.Random(5)
    alphabets = ["ab", "theringao ", "aeiou \n\t'", "'s're've éß中\U0001f600#*$%&", "   \x1c\x85", "0123456789²Ⅻ ."]
    texts = ["", " ", "a" * 5000, " " * 3000, "the<|endoftext|>the", "<|endoftext|>", "<|endoftext", "中" * 700, "x\n\n  y'll I'LL"]
    for _ in range(1500):
        alphabet = rng.choice(alphabets)
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))))
    for _ in range(300):
        texts.append("".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x2FF), rng.randint(0x4E00, 0x4FFF)])) for _ in range(30)))
    for text, expected in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert _ids(text) == expected.ids, repr(text[:80])


def test_every_token_is_its_own_encoding(tokenizer):
    tables = vocabulary(VOCABULARY)
    for data, outer in zip(tables.bytes, tables.outer):
        text = data.decode("utf-8", "ignore")
        if text.encode() == data:
            assert list(tables.encode_piece(text)) == tokenizer.encode(text, add_special_tokens=False).ids or " " in text[1:] or len(tokenizer.encode(text, add_special_tokens=False).ids) > 1


def test_documents_match_the_library(spark, tokenizer):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {r.doc_id: r for r in digests(encode(docs, VOCABULARY)).collect()}
    assert rows.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        row = rows[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows(spark):
    schema = "doc_id long, text string, ids string, Decoded int, other string"
    long_text = "longest " * 200_000
    rows = [(1, None, "x", 1, None), (None, "", "y", 2, "o"), (3, "a b", None, 3, "o"), (3, "a b", None, 3, "o"), (4, long_text, "z", 4, "o")]
    out = encode(spark.createDataFrame(rows, schema), VOCABULARY)
    assert out.columns == ["doc_id", "text", "other", "ids", "decoded"]
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [len(r.ids) for r in got[:3]] == [0, 2, 2] and got[0].decoded == ""
    assert got[3].decoded == long_text and got[-1].ids == []
    assert encode(spark.createDataFrame([], schema), VOCABULARY).count() == 0


def test_paths_are_a_parameter():
    assert VOCABULARY == public_tokenizers.path("byte_bpe_50k.json")
