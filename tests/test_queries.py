import pytest
from oracle import DATA, connect, same

from stowage.plans import registry


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, con, name):
    same(registry.QUERIES[name](spark, DATA), con, registry.SQL[name])


def test_queries_without_sql_are_tested_here():
    assert set(registry.QUERIES) - set(registry.SQL) == {"record_hash", "merkle_fingerprint", "fastcdc_chunks", "chunk_stats", "blake3_digests", "p4_packed"}


def _texts(con):
    return {i: t.encode() for i, t in con.sql("select doc_id, text from documents where text is not null").fetchall()}


def test_chunks_of_all_texts(spark, con):
    """The chunks make up each text (their cut points are checked in test_reference)."""
    texts, got = _texts(con), {}
    for r in registry.QUERIES["fastcdc_chunks"](spark, DATA).collect():
        got.setdefault(r.doc_id, []).append((r.offset, r.length))
    for i, t in texts.items():
        places = sorted(got.get(i, []))
        assert sum(n for _, n in places) == len(t) and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert all(64 <= n <= 1024 for _, n in places[:-1])
    assert set(got) == {i for i, t in texts.items() if t}
    stats = {r.doc_id: r for r in registry.QUERIES["chunk_stats"](spark, DATA).collect()}
    assert {i: r.chunks for i, r in stats.items()} == {i: len(x) for i, x in got.items()}


def test_digests_of_all_texts(spark, con):
    from stowage.functions import blake3

    got = dict(map(tuple, registry.QUERIES["blake3_digests"](spark, DATA).collect()))
    assert got == {i: blake3.digest(t) for i, t in _texts(con).items()}


def test_record_hashes_are_those_of_the_texts(spark):
    from stowage.functions import blake3

    texts = dict(map(tuple, registry.QUERIES["record_texts"](spark, DATA).collect()))
    assert dict(map(tuple, registry.QUERIES["record_hash"](spark, DATA).collect())) == {n: blake3.digest(t.encode()) for n, t in texts.items()}
