import os
import random
from datetime import datetime

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage.functions import digests
from stowage.operators import compaction, intervals, orphans

# -- orphan references ------------------------------------------------------------


def alive(parents, ref, at):
    mine = [(s, u) for k, s, u in parents if k == ref and s is not None]
    if not mine:
        return "missing"
    if at is None:
        return None
    if at < min(s for s, _ in mine):
        return "late"
    return None if any(s <= at and (u is None or u > at) for s, u in mine) else "deleted"


@pytest.mark.parametrize("bound, parts", [(32 << 20, 8), (64, 8), (64, 1)])
def test_orphans_against_brute_force(spark, bound, parts):
    r = random.Random(5)
    parents = [(f"k{r.randint(0, 30)}", s := r.randint(0, 400_000), r.choice([None, s + r.randint(1, 300_000)])) for _ in range(120)]
    refs = [(i, r.choice([None, "k1", f"k{r.randint(0, 45)}"]), r.choice([None, r.randint(0, 500_000)]), "clash") for i in range(600)]
    refs += refs[:50]
    p = spark.createDataFrame(parents + [(None, 1, None), ("k99", None, None)], "key string, since long, until long").selectExpr("*", "1 as ref", "2 as _days")
    d = spark.createDataFrame(refs, "id long, ref string, at long, _block string")
    got = orphans.find_orphans(d, p, ["id", "_block"], max_filter_bytes=bound, max_parts=parts)
    want = {(i, x, ref, at, why) for i, ref, at, x in refs if ref is not None and (why := alive(parents, ref, at))}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_orphans_of_empty_tables(spark):
    p = spark.createDataFrame([("a", 1, None)], "key string, since long, until long")
    d = spark.createDataFrame([("a", 0), ("b", 5)], "ref string, at long")
    assert rows(orphans.find_orphans(d.limit(0), p)) == []
    assert rows(orphans.find_orphans(d, p.limit(0)), "ref", "reason") == [("a", "missing"), ("b", "missing")]
    assert rows(orphans.find_orphans(d, p), "ref", "reason") == [("a", "late"), ("b", "missing")]


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) as ref")
    blocks = orphans.bloom_blocks(3000)
    table = orphans.bloom_table(keys, "ref", blocks)
    for parts, most in ((1, 8), (3, 8), (3, 2)):
        assert orphans.bloom_probe(keys, "ref", table, blocks, parts, most).where("not _maybe").count() == 0
    other = spark.range(20000).selectExpr("concat('x', id) as ref")
    assert orphans.bloom_probe(other, "ref", table, blocks).where("_maybe").count() < 600


# -- intervals ---------------------------------------------------------------------


def sweep(items, max_gap=None):
    out = set()
    by = {}
    for h, s, t in items:
        if h is not None and s is not None and t is not None and t > s:
            by.setdefault(h, []).append((s, t))
    for h, xs in by.items():
        busy = []
        for s, t in sorted(xs):
            if busy and s <= busy[-1][1]:
                busy[-1][1] = max(busy[-1][1], t)
            else:
                busy.append([s, t])
        out |= {(h, "busy", s, t) for s, t in busy}
        out |= {(h, "gap", a[1], b[0]) for a, b in zip(busy, busy[1:]) if max_gap is None or b[0] - a[1] <= max_gap}
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-50, 50)), st.one_of(st.none(), st.integers(-50, 60))), max_size=25), st.sampled_from([None, 3]), st.sampled_from([4, 1000]))
def test_intervals_against_brute_force(spark, items, gap, bucket):
    df = spark.createDataFrame(items, "k string, s long, t long")
    got = intervals.periods_and_gaps(df, "k", "s", "t", gap, bucket)
    table = [tuple(x) for x in got.collect()]
    assert len(table) == len(set(table)) and set(table) == sweep(items, gap)


def test_intervals_touch_nest_and_repeat(spark):
    df = spark.createDataFrame([("h", 0, 5, 1), ("h", 5, 9, 2), ("h", 1, 2, 3), ("h", 1, 2, 3), ("h", 12, 13, 4), ("h", 14, 14, 5)], "host string, b long, next long, at long")
    assert rows(intervals.periods_and_gaps(df, "host", "b", "next")) == [("h", "busy", 0, 9), ("h", "busy", 12, 13), ("h", "gap", 9, 12)]


# -- compaction ------------------------------------------------------------------------


def test_pack_and_unpack_lose_nothing(spark):
    r = random.Random(2)
    files = [(f"d{r.randint(0, 2)}/f{i}", bytes(r.randbytes(r.choice([0, 1, 50, 300])))) for i in range(200)] + [("big/one", r.randbytes(5000)), ("null/one", None)]
    df = spark.createDataFrame(files, "path string, content binary").withColumn("directory", digests.directory("path")).selectExpr("*", "'x' as container", "1 as _no", "2 as block")
    packed = compaction.pack(df, target_bytes=1000, lane_files=20)
    back = compaction.unpack(packed).collect()
    assert all(x.ok for x in back)
    assert sorted((x.path, bytes(x.content)) for x in back) == sorted(f for f in files if f[1] is not None)
    assert packed.count() < 80
    assert [(x.path, bytes(x.content)) for x in compaction.lookup(packed, ["big/one"]).collect()] == [files[200]]
    for c in packed.collect():
        ends = [(e.offset, e.offset + e.length) for e in c["index"]]
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[-1][1] == len(c.block)


def test_pack_edge_cases(spark):
    df = spark.createDataFrame([(None, "a", b"x"), (None, None, b"y"), ("d", "b", b"")], "directory string, path string, content binary")
    assert sorted((x.path, bytes(x.content), x.ok) for x in compaction.unpack(compaction.pack(df)).collect()) == [("a", b"x", True), ("b", b"", True)]
    assert compaction.unpack(compaction.pack(df.limit(0))).count() == 0


def test_archive_lookup_opens_the_named_blocks_only(spark, tmp_path):
    r = random.Random(6)
    files = [(f"d{i % 7}/f{i}", r.randbytes(r.choice([0, 1, 90, 400]))) for i in range(300)] + [("_x/.y", b"hidden"), ("null/one", None)]
    df = spark.createDataFrame(files, "path string, content binary").withColumn("directory", digests.directory("path"))
    root = str(tmp_path / "a")
    compaction.write_archive(df, root, target_bytes=8000, buckets=8)
    index = compaction.archive_index(spark, root)
    want = {p: c for p, c in files if c is not None}
    assert {(x.path, bytes(x.content), x.ok) for x in compaction.read_archive(index, root).collect()} == {(p, c, True) for p, c in want.items()}
    blocks = {x.container for x in index.collect()}
    assert sorted(os.listdir(f"{root}/blocks")) == sorted(blocks) and 5 < len(blocks) < 40
    named = {x.path: x.container for x in index.where("path in ('d3/f10', '_x/.y')").collect()}
    for b in blocks - set(named.values()):
        os.remove(f"{root}/blocks/{b}")
    found = compaction.archive_lookup(spark, root, [*named, "not/there"], buckets=8)
    assert {(x.path, bytes(x.content), x.ok) for x in found.collect()} == {(p, want[p], True) for p in named}
    plan = index.where("bucket in (1) and path in ('a')")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "path" in plan.split("PushedFilters")[1]
    compaction.write_archive(df.limit(0), root, buckets=8)
    assert compaction.archive_lookup(spark, root, ["d3/f10"], buckets=8).count() == 0


def test_crowded_groups_and_plan(spark):
    files = [("d", f"d/{i}", i) for i in range(30)] + [("e", "e/1", 1)] + [("d", "d/big", 10**6), ("d", "d/none", None)]
    df = spark.createDataFrame(files, "directory string, path string, size long")
    small = compaction.crowded_small_files(df)
    plan = compaction.container_plan(small, target_bytes=100, lane_files=7).collect()
    assert sorted(x.path for x in plan) == sorted(f"d/{i}" for i in range(30))
    spans = {}
    for x in plan:
        spans.setdefault(x.container, []).append((x.offset, x.offset + x.length))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:]))


def test_containers_fill_across_groups(spark):
    """Many small directories, one split over lanes, and empty files."""
    files = [(f"d{i % 90}", f"d{i % 90}/{i}", i % 40) for i in range(3000)] + [("hot", f"hot/{i}", 10) for i in range(1000)]
    df = compaction.crowded_small_files(spark.createDataFrame(files, "directory string, path string, size long"))
    for target, lane_files in ((20_000, 64), (20_000, 65_536), (10**9, 64)):
        plan = compaction.container_plan(df, target_bytes=target, lane_files=lane_files).collect()
        assert sorted((x.directory, x.path, x.length) for x in plan) == sorted(files)
        spans, cost = {}, {}
        for x in plan:
            spans.setdefault(x.container, []).append((x.offset, x.offset + x.length))
            cost[x.container] = cost.get(x.container, 0) + x.length + compaction.ENTRY_BYTES
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
        full = sorted(cost.values())[1:]
        assert all(target - 200 < c < target + 200 for c in full), full
        assert len(cost) == -(-sum(f[2] + compaction.ENTRY_BYTES for f in files) // target)


def test_packed_query_fills_containers(spark):
    from oracle import DATA

    from stowage.plans import problems

    packed = problems.p4_packed(spark, DATA)
    assert rows(packed, "path", "digest", "length") == rows(problems.p4_plan(spark, DATA), "path", "digest", "length")
    assert packed.select("container").distinct().count() == 1  # 1.8 MB in six directories


def test_found_executes_the_packing(spark):
    from oracle import DATA

    from stowage.plans import problems

    plan = problems.p4_found(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") >= 3 and "collect_list" in plan, plan


# -- names -----------------------------------------------------------------------------


def test_digest_keys_paths_and_hosts(spark):
    h = "A" * 64
    df = spark.createDataFrame([(h, None), (f" sha256:{h} ", "blake3"), (h, " SHA256 "), (None, None), ("x", "")], "d string, a string")
    got = [r[0] for r in df.select(digests.digest_key("d", "a")).collect()]
    low = h.lower()
    assert got == [f"blake3:{low}", f"sha256:{low}", f"sha256:{low}", None, "blake3:x"]
    paths = ["a/b", " a//b/ ", "a\\.\\b", "../a/./../b", "a/b/../../..", "", None, "/x", "a/..b", "..."]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(digests.normal_path("p")).collect()] == ["a/b", "a/b", "a/b", "b", None, None, None, "x", "a/..b", "..."]
    df = spark.createDataFrame([("a/b/c",), ("a",)], "p string")
    assert [r[0] for r in df.select(digests.directory("p")).collect()] == ["a/b", ""]
    df = spark.createDataFrame([(" Forge-1.rack.x ",), ("unknown",), ("  ",), (None,), (".x",)], "h string")
    assert [r[0] for r in df.select(digests.host("h")).collect()] == ["forge-1", None, None, None, None]


def _write(spark, tmp_path, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))


def test_problem_queries_on_null_and_empty_tables(spark, tmp_path):
    from oracle import DATA

    from stowage.plans import problems

    for name in ("recipes", "recipe_templates", "graph_nodes", "executions", "output_files", "blobs", "documents"):
        t = spark.read.parquet(f"{DATA}/{name}.parquet")
        blank = spark.createDataFrame([(1,)], "i int").selectExpr(*[f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in t.schema])
        t.limit(0).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
        blank.union(blank).write.parquet(str(tmp_path / "null" / f"{name}.parquet"))
    for kind in ("empty", "null"):
        for q in ("p1_found", "p1_paths", "p1_descendants", "p2_found", "p4_found", "p4_archive", "p5_found"):
            assert getattr(problems, q)(spark, str(tmp_path / kind)).count() == 0, (kind, q)


def test_periods_of_executions(spark, tmp_path):
    from stowage.plans import problems

    t = lambda h: datetime(2020, 1, 1, h)
    data = [
        (1, "A.x", t(1), t(2), t(3)),
        (1, "b", t(1), t(5), t(4)),  # the later record counts
        (2, " B ", t(5), t(6), t(6)),
        (3, "unknown", t(1), t(9), t(9)),
        (4, "b", t(8), t(8), t(9)),
        (5, "b", t(7), t(9), None),
    ]
    _write(spark, tmp_path, "executions", data, "execution_id long, hostname string, started_at timestamp, completed_at timestamp, recorded_at timestamp")
    got = {(x.hostname, x.kind, x.end_us - x.start_us) for x in problems.p5_found(spark, str(tmp_path)).collect()}
    hour = 3_600_000_000
    assert got == {("b", "busy", 5 * hour), ("b", "gap", hour), ("b", "busy", 2 * hour)}
