import random

import numpy as np
import pytest
from conftest import rows
from oracle import DATA

from stowage.llm import queries, spans


def brute(docs, length):
    first, multi = {}, set()
    for i, t in docs:
        for p in range(len(t or "") - length + 1):
            if first.setdefault(t[p : p + length], i) != i:
                multi.add(t[p : p + length])
    out = set()
    for i, t in docs:
        at = None
        for p in range(len(t or "") - length + 1):
            if t[p : p + length] in multi:
                if at and p <= at[1]:
                    at[1] = p + length
                else:
                    at and out.add((i, *at))
                    at = [p, p + length]
        at and out.add((i, *at))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % spans.PERIOD for a in spans.COVER for b in spans.COVER} == set(range(spans.PERIOD))


@pytest.mark.parametrize("length", [1, 2, 3, 118, 300])
def test_window_hashes(length):
    r = np.random.default_rng(1)
    codes = np.r_[r.integers(0, 3, 700), r.integers(0, 0x10FFFF, 50)].astype(np.uint32)
    codes = np.r_[codes, codes]
    h = spans.window_hashes(codes, length, 1)
    assert len(h) == len(codes) - length + 1
    same = {}
    for i, x in enumerate(h.tolist()):
        assert same.setdefault(codes[i : i + length].tobytes(), x) == x
    assert len(set(same.values())) == len(same)
    assert len(spans.window_hashes(codes[: length - 1], length, 1)) == 0


def corpus(seed):
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abcdé中😀 ") for _ in range(n))
    pieces = [make(r.choice([205, 299, 300, 301, 450, 900])) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = [make(r.randint(0, 250))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(pieces)
            a = r.randint(0, 40)
            parts += [p[a:], make(r.choice([0, 1, 90]))]
        docs.append((i, "".join(parts)))
    docs += [(100, docs[0][1] * 1), (101, None), (102, ""), (103, "x" * 1000), (104, "x" * 700), (105, pieces[4] + pieces[4])]
    return docs


@pytest.mark.parametrize("seed, chunk, few, hot, blocks", [(1, 10**6, 10**6, 10**5, 10**5), (2, 3000, 10**6, 2, 2), (3, 900, 0, 10**5, 10**5), (5, 700, 0, 0, 1), (6, 900, 10**6, 4, 10**5)])
def test_against_brute_force(spark, monkeypatch, seed, chunk, few, hot, blocks):
    monkeypatch.setattr(spans, "GROUP_ROWS", 20)
    docs = corpus(seed)
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").selectExpr("*", "1 as id", "2 as h1", "3 as span_start", "4 as t").repartition(3)
    got = spans.shared_spans(df, "doc_id", "text", broadcast_rows=few, chunk_chars=chunk, hot_rows=hot, hot_blocks=blocks)
    assert {tuple(x) for x in got.collect()} == brute(docs, 300) and got.count() == len(brute(docs, 300))


def test_copies_need_one_anchor_a_period(spark):
    """All places of copies lie at one remainder, so thirteen of fourteen anchors are left out."""
    r = random.Random(8)
    text = "".join(r.choice("abcdefgh ") for _ in range(5000))
    rows_ = spark.createDataFrame([(i, text) for i in range(40)], "id long, t string")
    sent = rows_.mapInArrow(spans._emit_anchors(300, 10**6), "h bigint, low bigint, high bigint, mask bigint, n bigint").collect()
    assert sum(x.mask == 1 for x in sent) <= 2 * len(sent) / 14 and {x.mask.bit_count() for x in sent} == {1}
    df = rows_.withColumnsRenamed({"id": "doc_id", "t": "text"})
    assert {tuple(x) for x in spans.shared_spans(df, "doc_id", "text").collect()} == {(i, 0, 5000) for i in range(40)}


def test_other_lengths(spark):
    docs = corpus(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(x) for x in spans.shared_spans(df, "doc_id", "text", 210).collect()} == brute(docs, 210)
    with pytest.raises(ValueError):
        spans.shared_spans(df, "doc_id", "text", 100)


def test_edges(spark):
    df = spark.createDataFrame([(1, "y" * 400), (1, "y" * 400), (2, None), (None, "y" * 400)], "doc_id long, text string")
    assert spans.shared_spans(df, "doc_id", "text").count() == 0
    assert spans.shared_spans(df.limit(0), "doc_id", "text").count() == 0
    two = spark.createDataFrame([(1, "y" * 400), (2, "y" * 300)], "doc_id long, text string")
    assert rows(spans.shared_spans(two, "doc_id", "text")) == [(1, 0, 400), (2, 0, 300)]


def test_query_and_share(spark):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = brute(docs, 300)
    assert {tuple(x) for x in queries.p8_found(spark, DATA).collect()} == want
    share = {x.doc_id: x.shared_chars for x in queries.p8_share(spark, DATA).collect()}
    assert share == {d: sum(b - a for i, a, b in want if i == d) for d in {i for i, _, _ in want}}


def test_shares_of_every_document(spark):
    df = spark.createDataFrame([(1, "y" * 400), (2, "y" * 300 + "z" * 100), (3, "abc"), (4, ""), (5, None), (None, "x")], "doc_id long, text string")
    got = spans.shared_share(spans.shared_spans(df, "doc_id", "text"), df, "doc_id", "text", every=True)
    assert rows(got) == [(1, 400, 400, 1.0), (2, 400, 300, 0.75), (3, 3, 0, 0.0), (4, 0, 0, None), (5, None, 0, None)]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id is not null")
    assert rows(queries.p8_shares(spark, DATA), "doc_id") == rows(docs.select("doc_id").distinct())
