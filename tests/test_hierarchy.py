import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stowage.operators import graph, hierarchy


def brute(nodes, links):
    """(node, root, depth) and the closure, by plain search."""
    out = {n: {d for s, d in links if s == n and d in nodes} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(out[n])
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += out[v]
        reach[n] = seen
    ring = {n for n in nodes if n in reach[n]}
    found, least = set(), {}

    def ways(n):
        if not out[n]:
            return {n: (0, ())}
        best = {}
        for d in out[n]:
            for r, (k, p) in ways(d).items():
                best[r] = min(best.get(r, (1, ())), (k - 1, (d, *p)))
        return best

    for n in nodes:
        bad = (reach[n] | {n}) & ring
        if bad:
            found.add((n, min(bad), -1 if n in ring else -2))
        else:
            found |= {(n, r, -k) for r, (k, _) in ways(n).items()}
            least |= {(n, r): list(p) for r, (_, p) in ways(n).items()}
    return found, least, {(a, b) for a in nodes for b in reach[a]}


def frames(spark, nodes, links):
    n = spark.createDataFrame([(x, i) for i, x in enumerate(nodes)], "name string, place long")
    return n, spark.createDataFrame(list(links), "src string, dst string")


@pytest.mark.parametrize("seed, size, width", [(1, 14, 3), (2, 30, 4), (3, 30, 50)])
def test_random_graphs_with_cycles(spark, seed, size, width):
    r = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(size)]
    links = {(nodes[i], nodes[max(0, i - r.randint(1, 5))]) for i in range(1, size) for _ in range(r.randint(0, 2))}
    links |= {(r.choice(nodes), r.choice(nodes)) for _ in range(2)}
    links |= {(nodes[3], "nowhere"), ("nowhere", nodes[1])}
    n, e = frames(spark, nodes, links)
    found, least, closure = brute(nodes, links)
    got = hierarchy.hierarchies(n, e, fragment_nodes=width)
    table = got.collect()
    assert {(x.node, x.root, x.depth) for x in table} == found
    for x in table:
        if x.depth >= 0:
            way = [x.node, *x.path]
            assert way[-1] == x.root and len(x.path) == x.depth
            assert all((a, b) in links for a, b in zip(way, way[1:]))
            assert x.path == least[x.node, x.root]
    assert {tuple(x) for x in hierarchy.reachability(n, e, fragment_nodes=width).collect()} == closure
    starts = spark.createDataFrame([(nodes[-1],), (nodes[size // 2],), ("nowhere",), (nodes[-1],)], "name string")
    want = {b for a, b in closure if a in (nodes[-1], nodes[size // 2])}
    assert {x.name for x in hierarchy.reached(n, e, starts, fragment_nodes=width).collect()} == want


def test_cycle_across_fragments_is_one_component(spark):
    nodes = [f"n{i}" for i in range(9)]
    links = {(nodes[i], nodes[(i + 1) % 9]) for i in range(9)}
    got = hierarchy.hierarchies(*frames(spark, nodes, links), fragment_nodes=1).collect()
    assert {(x.root, x.depth) for x in got} == {("n0", -1)} and len({x.cycle for x in got}) == 1


def test_edge_cases(spark):
    n = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), ("b", None, None)], "name string, place long, node string")
    e = spark.createDataFrame([("b", "a", "k"), ("b", "a", "l"), ("b", None, None), (None, "a", None)], "src string, dst string, root string")
    assert rows(hierarchy.hierarchies(n, e), "node", "root", "depth") == [("a", "a", 0), ("b", "a", 1)]
    none = hierarchy.hierarchies(n.limit(0), e)
    assert none.count() == 0
    alone = hierarchy.hierarchies(n, e.limit(0))
    assert rows(alone, "node", "depth") == [("a", 0), ("b", 0)]
    me = spark.createDataFrame([("b", "b")], "src string, dst string")
    assert ("b", "b", -1) in rows(hierarchy.hierarchies(n, me), "node", "root", "depth")


def test_deep_chain_in_random_order(spark):
    r = random.Random(9)
    nodes = [f"n{i:04d}" for i in range(3000)]
    links = {(nodes[i], nodes[i - 1]) for i in range(1, 3000)}
    n = spark.createDataFrame([(x, r.random()) for x in nodes], "name string, place double")
    e = spark.createDataFrame(list(links), "src string, dst string")
    got = hierarchy.hierarchies(n, e, fragment_nodes=500, paths=False).collect()
    assert {x.node: x.depth for x in got} == {x: i for i, x in enumerate(nodes)}
    assert all(x.path is None for x in got)


@pytest.mark.parametrize("shape", ["chain", "tree", "star"])
def test_no_task_takes_more_than_a_fragment(spark, monkeypatch, shape):
    """Nodes in random order: the largest task of any round stays within twice the bound."""
    r = random.Random(10)
    size, bound = 12_000, 600
    nodes = [f"n{i:05d}" for i in range(size)]
    up = {"chain": lambda i: i - 1, "tree": lambda i: r.randrange(i), "star": lambda i: 0 if r.random() < 0.4 else i - 1}[shape]
    links = [(nodes[i], nodes[up(i)]) for i in range(1, size)]
    n = spark.createDataFrame([(x, r.random()) for x in nodes], "name string, place double")
    most, plain = [], hierarchy._contract

    def counted(rows_, size_, *rest):
        small, after = plain(rows_, size_, *rest)
        for x in (rows_, small):
            most.append(x.groupBy("f").agg(F.countDistinct("src").alias("n")).agg(F.max("n")).first()[0])
        return small, after

    monkeypatch.setattr(hierarchy, "_contract", counted)
    got = hierarchy.hierarchies(n, spark.createDataFrame(links, "src string, dst string"), fragment_nodes=bound, paths=False).collect()
    depth = {nodes[0]: 0}
    for a, b in links:
        depth[a] = depth[b] + 1
    assert {x.node: x.depth for x in got} == depth
    assert len(most) >= 2 and max(most) <= 2 * bound, most


def test_many_nodes_of_one_place(spark):
    nodes = [f"n{i:03d}" for i in range(60)]
    links = {(nodes[i], nodes[i - 1]) for i in range(1, 60)}
    n = spark.createDataFrame([(x, 7) for x in nodes], "name string, place long")
    e = spark.createDataFrame(list(links), "src string, dst string")
    got = {x.node: x.depth for x in hierarchy.hierarchies(n, e, fragment_nodes=10).collect()}
    assert got == {x: i for i, x in enumerate(nodes)}


def graph_of(spark, links, more=()):
    names = sorted({x for pair in links for x in pair} | set(more))
    nodes = spark.createDataFrame([(x, *x.split(":"), [d for s, d in links if s == x]) for x in names], "fqn string, cookbook string, recipe string, dependencies array<string>")
    return nodes, graph.edges(nodes)


def test_levels_diamond_and_plan(spark):
    links = [("a:d", "a:b"), ("a:d", "a:c"), ("a:b", "a:a"), ("a:c", "a:a"), ("a:c", "a:b")]
    n, e = graph_of(spark, links, ["z:z"])
    assert rows(graph.levels(n, e), "level", "fqn") == [(0, "a:a"), (0, "z:z"), (1, "a:b"), (2, "a:c"), (3, "a:d")]
    targets = spark.createDataFrame([("a:c",)], "fqn string")
    assert rows(graph.plan_for(targets, n, e), "level", "fqn") == [(0, "a:a"), (1, "a:b"), (2, "a:c")]
    assert rows(graph.transitive_dependencies("a:d", e)) == [("a:a",), ("a:b",), ("a:c",)]
    assert rows(graph.transitive_dependencies("no:one", e)) == []
    assert rows(graph.plan_statistics(graph.levels(n, e))) == [(5, 4, 2)]
    with pytest.raises(graph.UnknownTarget, match="no:one"):
        graph.plan_for(spark.createDataFrame([("no:one",)], "fqn string"), n, e)


def test_cycles_are_reported(spark):
    n, e = graph_of(spark, [("a:a", "b:b"), ("b:b", "a:a"), ("c:c", "c:c"), ("d:d", "a:a")])
    assert sorted(x.fqn for x in graph.cycles(n, e).collect()) == ["a:a", "b:b", "c:c"]
    with pytest.raises(graph.CycleError, match="a:a"):
        graph.levels(n, e, strict=True)
    assert graph.levels(n, e).count() == 0


def test_unqualified_missing_and_blank_references(spark):
    n = spark.createDataFrame([("a:x", ["y", " b:z ", "", None, "y"]), ("a:y", None)], "fqn string, dependencies array<string>")
    assert rows(graph.edges(n)) == [("a:x", "a:y"), ("a:x", "a:y")]
    assert rows(graph.missing_dependencies(n)) == [("a:x", "b:z")]


@pytest.mark.parametrize("width", [1, 2, 100])
def test_fingerprints(spark, width):
    from stowage.functions import blake3

    links = [(f"a:{i}", f"a:{j}") for i in range(1, 8) for j in {i - 1, i // 2}]
    n, e = graph_of(spark, links)
    n = n.selectExpr("*", "sha2(fqn, 256) as self_hash", "cast(recipe as long) as place")
    memo, own = {}, {r.fqn: r.self_hash for r in n.collect()}.get

    def h(x):
        if x not in memo:
            memo[x] = blake3.digest((own(x) + "".join(sorted(h(d) for s, d in links if s == x))).encode())
        return memo[x]

    assert {tuple(r) for r in graph.fingerprints(n, e, width).collect()} == {(f"a:{i}", h(f"a:{i}")) for i in range(8)}
    # repeated edges count, order does not
    twice = e.unionByName(e.where("src = 'a:1'").limit(1))
    changed = dict(map(tuple, graph.fingerprints(n, twice, width).collect()))
    assert changed["a:1"] != h("a:1") and changed["a:0"] == h("a:0")


def test_fingerprints_of_wide_levels_and_cycles(spark):
    from stowage.functions import blake3

    links = [(f"a:{i}", f"a:{i % 3}") for i in range(3, 40)] + [(f"b:{i}", f"a:{i + 3}") for i in range(9)] + [("c:1", "c:2"), ("c:2", "c:1"), ("c:3", "c:1")]
    n, e = graph_of(spark, links)
    n = n.selectExpr("*", "fqn as self_hash")
    deps = {a: [d for s, d in links if s == a] for a, _ in links}

    def h(x):
        return blake3.digest((x + "".join(sorted(map(h, deps.get(x, [])))).strip()).encode())

    want = {(x, h(x)) for x in {y for pair in links for y in pair} if not x.startswith("c:")}
    for width in (5, 30):
        assert {tuple(r) for r in graph.fingerprints(n, e, width).collect()} == want
