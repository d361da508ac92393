import os
import random

import pytest
from oracle import DATA

from stowage.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")
PATH = os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def own(texts):
    bounds, ids = bpe.encoder(PATH).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_hard_texts(library):
    texts = ["", None, "<|endoftext|>", "a" * 3000, " " * 500 + "x", "\r\n\t   ", "it's 'S they'll", "日本語のテキスト", "éé", "👩‍👩‍👧‍👦", "\u0000​", "aaaa bbbb" * 400]
    assert own(texts) == library(texts)


def test_random_texts(library):
    r = random.Random(1)
    letters = "aaabce  \n\t'strevml1٣Ⅷ.,!?é中😀"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(800)]
    assert own(texts) == library(texts)


def test_every_character_is_classed_like_the_library(library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["é中".join(chars[i : i + 64]) + "1".join(chars[i : i + 64]) for i in range(0, len(chars), 64)]
    assert own(texts) == library(texts)


def test_store_is_bounded_and_forgets_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "STORE_WORDS", 50)
    e = bpe.Encoder(PATH)
    for k in range(6):
        texts = [f"word{k}x{i} and{i}" for i in range(40)]
        bounds, ids = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == library(texts)


@pytest.mark.parametrize("size", [1, 3, 10, 50])
def test_pieces_join_to_the_whole(library, size):
    r = random.Random(size)
    for _ in range(150):
        text = "".join(r.choice("ab 1'\ts\n.é  ​\u3000") for _ in range(r.randint(0, 120)))
        cut = list(bpe.pieces(text, size))
        assert "".join(cut) == text
        assert sum(own(cut), []) == library([text])[0]


def test_column(spark, library):
    data = [(1, "some text here"), (2, None), (3, ""), (1, "some text here"), (None, "long " * 500)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' as _text", "1 as ids")
    got = [(x.doc_id, list(x.ids)) for x in bpe.encode_column(df, "doc_id", "text", chunk_chars=40).collect()]
    assert sorted(got, key=repr) == sorted([(i, ids) for (i, _), ids in zip(data, library([t for _, t in data]))], key=repr)
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_query(spark, library):
    got = {x.doc_id: list(x.ids) for x in queries.p6_ids(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([d.doc_id for d in docs], library([d.text for d in docs])))
