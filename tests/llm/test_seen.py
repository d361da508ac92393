import random

import numpy as np
import pytest
from oracle import DATA, connect, same

from stowage.llm import queries, seen
from stowage.llm.ribbon import Ribbon


@pytest.mark.parametrize("n", [0, 1, 7, 600, 40_000])
@pytest.mark.parametrize("bits", [8, 20, 32, 40])
def test_ribbon_holds_all_its_keys(n, bits):
    r = np.random.default_rng(n + bits)
    hi, lo = (r.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
    f = Ribbon(hi, lo, bits)
    assert f.contains(hi, lo).all()
    a, b = (r.integers(0, 2**64, 60_000, dtype=np.uint64) for _ in range(2))
    rate = f.contains(a, b).mean()
    assert rate <= 2.0**-bits * 1.5 + 5e-4


def test_ribbon_with_repeated_and_unsolvable_keys():
    hi = np.zeros(500, np.uint64)
    lo = np.repeat(np.arange(5, dtype=np.uint64), 100)
    assert Ribbon(hi, lo, 16).contains(hi, lo).all()
    tight = np.arange(3000, dtype=np.uint64)
    f = Ribbon(tight, tight, 16, slack=0.5)  # too narrow: most keys are kept exactly
    assert f.contains(tight, tight).all() and f.exact


def brute(table):
    first, out = {}, set()
    for i, k in table:
        if i is not None and k is not None:
            first[k] = min(i, first.get(k, i))
    return {i for i, k in table if i is not None and k is not None and i > first[k]}


def test_seen_before_against_brute_force(spark):
    r = random.Random(3)
    a = [(r.choice([None, i, i]), r.choice([None, "hot", f"k{r.randint(0, 900)}"])) for i in range(3000)]
    b = [(i, f"k{r.randint(0, 5000)}") for i in range(2000)]
    a += a[:300]
    r.shuffle(a)
    frames = [spark.createDataFrame(x, "id long, key string").selectExpr("*", "1 as part", "2 as shard", "3 as hi").repartition(5) for x in (a, b)]
    got = {tuple(x) for x in seen.seen_before(frames, batch_keys=64).collect()}
    assert got == {(0, i) for i in brute(a)} | {(1, i) for i in brute(b)}


def test_seen_before_edge_cases(spark):
    empty = spark.createDataFrame([], "id long, key string")
    assert seen.seen_before([empty, empty]).count() == 0
    one = spark.createDataFrame([(5, "a"), (5, "a"), (7, "a"), (7, "a"), (1, None), (None, "a")], "id long, key string")
    assert [tuple(x) for x in seen.seen_before([one]).collect()] == [(0, 7)]


@pytest.mark.parametrize("batch_keys", [64, 1000, 4096])
def test_every_id_delivered_twice_from_other_partitions(spark, batch_keys):
    once = spark.range(20_000).selectExpr("id", "concat('k', id) as key")
    both = once.repartition(3).unionByName(once.where("id > 0").repartition(2))
    assert both.count() == 39_999
    assert seen.seen_before([both], batch_keys=batch_keys).count() == 0


@pytest.mark.parametrize("store_keys, task_rows", [(300, 250_000), (10**6, 200)])
def test_sealed_generations_answer_later_records(spark, tmp_path, monkeypatch, store_keys, task_rows):
    monkeypatch.setattr(seen, "TASK_ROWS", task_rows)
    path = str(tmp_path / "store")
    batch = lambda a, b: spark.range(a, b).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id div 2)) as key", "1 as shard", "2 as hi")
    assert seen.probe(batch(0, 10), path).count() == 0
    assert seen.seal(batch(0, 4000).unionByName(batch(0, 500)), path, shards=4, store_keys=store_keys) == 0
    assert seen.seal(batch(3000, 6000).repartition(7), path, store_keys=store_keys) == 1
    held = spark.read.parquet(path)
    keys = batch(0, 6000).select("key").distinct().count()
    assert held.agg({"keys": "sum"}).first()[0] == keys  # each key once, in one generation
    assert held.count() > 8 or store_keys > 10**5
    old = {r.key for r in batch(0, 6000).collect()}
    later = batch(5000, 9000).unionByName(spark.createDataFrame([(None, "k1", 0, 0), (1, None, 0, 0), (2, "k1", 0, 0), (2, "k1", 0, 0)], "id long, key string, shard int, hi int"))
    want = sorted({r.id for r in later.collect() if r.key in old and r.id is not None})
    assert sorted(r.id for r in seen.probe(later, path).collect()) == want
    wrong = seen.audit_store(spark, path).first()
    assert (wrong["keys"], wrong.wrong, wrong.rate) == (keys, 0, 0.0) and wrong.probes > 0


def test_advancing_batch_by_batch_is_one_pass(spark, tmp_path):
    r = random.Random(9)
    table = [(i, r.choice(["hot", f"k{r.randint(0, 700)}"])) for i in range(3000)]
    got = set()
    for a in range(0, 3000, 1000):
        df = spark.createDataFrame(table[a : a + 1000] + table[a : a + 50], "id long, key string").repartition(3)
        got |= {x.id for x in seen.advance(df, str(tmp_path / "s")).collect()}
    assert got == brute(table)
    assert seen.advance(spark.createDataFrame([], "id long, key string"), str(tmp_path / "s")).count() == 0
    low = str(tmp_path / "low")
    seen.seal(spark.range(30_000).selectExpr("concat('k', id) as key"), low, bits=8, shards=2)
    a = seen.audit_store(spark, low).first()
    assert 0 < a.rate <= 2 * a.bound


def test_dumped_filters_load_again():
    r = np.random.default_rng(1)
    hi, lo = (r.integers(0, 2**64, 3000, dtype=np.uint64) for _ in range(2))
    for bits, slack in ((8, 1.12), (12, 1.12), (32, 0.5), (40, 1.12)):
        f = Ribbon(hi, lo, bits, slack)
        g = Ribbon.load(f.dump())
        assert g.contains(hi, lo).all() and g.exact == f.exact and (g.table == f.table).all() and g.nbytes == f.nbytes


def test_audit_reports_the_rate(spark):
    df = spark.range(5000).selectExpr("id", "concat('k', id) as key")
    low = seen.audit([df], bits=8, batch_keys=256).first()
    assert low.keys > 4900 and low.filters >= 12 and low.probes > 0
    assert 0 < low.rate <= low.bound * 2
    assert seen.audit([df], batch_keys=256).first().wrong == 0


def test_query_against_sql(spark):
    same(queries.p3_found(spark, DATA), connect(DATA), queries.SQL["p3_found"])
    same(queries.p3_sealed(spark, DATA), connect(DATA), queries.SQL["p3_sealed"])
    assert [(x.source_table, x.wrong) for x in queries.p3_audit(spark, DATA).collect()] == [("blobs", 0), ("output_files", 0)]


@pytest.mark.parametrize("batch_keys", [1, 100])
def test_repeated_id_at_the_edge_of_a_batch(batch_keys):
    shard = seen._Shard(32, batch_keys)
    ask = lambda *r: shard.seen(*(np.array(x, np.int64) for x in zip(*r))).tolist()
    assert ask((1, 5, 6), (2, 7, 7)) == [False, False]
    assert ask((2, 7, 7), (2, 5, 6), (3, 7, 7)) == [False, True, True]
    assert ask((3, 8, 8)) == [False]
    assert ask((3, 8, 8), (4, 8, 8)) == [False, True]
