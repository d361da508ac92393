"""Parent-child links to full hierarchies: paths, depths, roots, cycles.

Nodes are split into fragments of bounded size along an order that keeps related
nodes together. Inside a fragment, in one task, chains of links are contracted:
every node is tied directly to the roots it reaches, to the places where its
paths leave the fragment (exits) and to the local cycles it reaches, with the
longest distance and its path. Only nodes that other fragments link to (entries)
form the quotient graph, whose links are the contracted chains. It is solved by
the same operator over fewer fragments of the same size, until one is left; then
each level's results are expanded: a node's rows are its local roots and, for
every exit, its distance plus the exit's solution. Where the order keeps too few
related nodes together for the quotient to be small, its nodes are placed anew by
their links: one in ``HEADS`` is a head by hash, pointers double towards the next
head, and nodes with one head lie together. So a chain or tree in any order shrinks
by about that factor in every round, in fragments of bounded size. A cycle across fragments is a
strongly connected component of the quotient; the nodes of a fragment on it are
those on a way from one of its entries to one of its exits.

Links carry distance, path and the least name that a way along them passes, so
the least name on any cycle survives contraction.

Scale: a fragment's size is a parameter, not a property of the data, as long as nodes
have few links each; a node that a third of all nodes link to is one entry, and the
nodes of a head with too many are spread. Only where nodes with many links each lead
everywhere does a round not shrink the quotient even when it lies by its links; then
fragments grow, for lack of anything to contract (figures in the README). Rows leave
a task only per (node, root) or (node, exit), never per path.

Defined results: a node may link to several others (then it has a row for each
root it reaches); repeated links are one; links to unknown names, or of null or
unknown sources, are ignored; null names are no nodes; a node that links to
itself is on a cycle; of several longest paths the least is taken, name by name from
the node on; empty input gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut, cut_plain, shuffle_partitions

FRAGMENT_NODES = 20_000
#: Nodes that a fragment has at least where more fragments would only use more tasks.
LEAST_NODES = 5_000
#: One node in HEADS is a head; pointers double DOUBLINGS times; quantiles of the places.
HEADS, DOUBLINGS, QUANTILES = 8, 5, 64

_ROWS = "f int, src string, kind string, dst string, g int, dist bigint, low string, path array<string>"


class _Local:
    """One fragment: strongly connected components, then longest ways bottom-up."""

    def __init__(self, rows: pd.DataFrame, paths: bool = False):
        self.paths = paths
        self.fragment = int(rows["f"].iloc[0])
        self.links: dict[str, list[tuple]] = {}
        self.outer: dict[str, list[tuple]] = {}
        self.ends: dict[str, list[tuple]] = {}
        self.cyc: dict[str, str] = {}
        self.entries: set[str] = set()
        self.labels: dict[str, tuple[dict[str, str], dict[str, str]]] = {}
        nodes: dict[str, None] = {}
        columns = (rows[c].tolist() for c in ("src", "kind", "dst", "g", "dist", "low", "path"))
        for src, kind, dst, g, dist, low, path in zip(*columns):
            if kind == "entry":
                self.entries.add(src)
                continue
            if kind in ("in", "out"):  # scc label of an entry or of an exit
                self.labels.setdefault(low, ({}, {}))[kind == "out"][src] = low
                continue
            nodes[src] = None
            path = () if path is None else tuple(path)
            if kind == "root":
                self.ends.setdefault(src, []).append((dst, int(dist), path))
            elif kind == "cyc":
                self.cyc[src] = min(low, self.cyc.get(src, low))
            elif int(g) == self.fragment:
                self.links.setdefault(src, []).append((dst, int(dist), low, path))
            else:
                self.outer.setdefault(src, []).append((dst, int(g), int(dist), low, path))
        self.nodes = sorted(nodes)
        self._components()
        self._ways()

    def _components(self) -> None:
        """Tarjan's algorithm without recursion; components come children first."""
        index: dict[str, int] = {}
        low: dict[str, int] = {}
        stack: list[str] = []
        on: set[str] = set()
        self.parts: list[list[str]] = []
        for start in self.nodes:
            if start in index:
                continue
            work = [(start, iter(self.links.get(start, ())))]
            index[start] = low[start] = len(index)
            stack.append(start)
            on.add(start)
            while work:
                v, children = work[-1]
                for c, *_ in children:
                    if c not in index:
                        index[c] = low[c] = len(index)
                        stack.append(c)
                        on.add(c)
                        work.append((c, iter(self.links.get(c, ()))))
                        break
                    if c in on:
                        low[v] = min(low[v], index[c])
                else:
                    work.pop()
                    if work:
                        u = work[-1][0]
                        low[u] = min(low[u], low[v])
                    if low[v] == index[v]:
                        part = []
                        while True:
                            x = stack.pop()
                            on.discard(x)
                            part.append(x)
                            if x == v:
                                break
                        self.parts.append(part)

    def _ways(self) -> None:
        # per node: root -> (dist, child, link path); exit -> (dist, child, link path, low)
        self.roots: dict[str, dict] = {}
        self.exits: dict[str, dict] = {}
        self.bad: dict[str, str] = {}
        self.ring: dict[str, str] = {}
        self.frag_of: dict[str, int] = {}
        for part in self.parts:
            inside = set(part)
            rings = [low for v in part for c, _, low, _ in self.links.get(v, ()) if c in inside]
            if rings:
                self._ring(part, inside, min(rings))
                continue
            v = part[0]
            roots: dict[str, tuple] = {}
            exits: dict[str, tuple] = {}
            bad = self.cyc.get(v)
            for r, dist, path in self.ends.get(v, ()):
                if r not in roots or (-dist, path) < (-roots[r][0], roots[r][2]):
                    roots[r] = (dist, None, path)
            for x, g, dist, low, path in self.outer.get(v, ()):
                self.frag_of[x] = g
                old = exits.get(x)
                if old is None or (-dist, path) < (-old[0], old[2]):
                    exits[x] = (dist, None, path, low if old is None else min(low, old[3]))
                elif low < old[3]:
                    exits[x] = (*old[:3], low)
            for c, dist, low, path in sorted(self.links.get(v, ())):
                b = self.bad.get(c)
                if b is not None and (bad is None or b < bad):
                    bad = b
                for r, way in self.roots[c].items():
                    if r not in roots or self._better(way[0] + dist, c, path, r, roots[r], self.roots):
                        roots[r] = (way[0] + dist, c, path)
                for x, way in self.exits[c].items():
                    old, least = exits.get(x), min(low, way[3])
                    if old is None or self._better(way[0] + dist, c, path, x, old, self.exits):
                        exits[x] = (way[0] + dist, c, path, least if old is None else min(least, old[3]))
                    elif least < old[3]:
                        exits[x] = (*old[:3], least)
            if bad is not None:
                self.bad[v] = bad
                roots = {}
            self.roots[v], self.exits[v] = roots, exits

    def _better(self, dist: int, child: str, path: tuple, end: str, old: tuple, table: dict[str, dict]) -> bool:
        """Whether a way is longer than the old one, or as long and its path less."""
        if dist != old[0] or not self.paths:
            return dist > old[0]
        mine, its = [*path, *self._path(child, end, table)], list(old[2])
        return mine < (its if old[1] is None else its + self._path(old[1], end, table))

    def _ring(self, part: list[str], inside: set[str], least: str) -> None:
        bad, name = least, min(part)
        exits: dict[str, tuple] = {}

        def reach(x: str, low: str) -> None:
            old = exits.get(x)
            low = min(low, least)
            exits[x] = (0, None, (), low if old is None else min(low, old[3]))

        for v in part:
            bad = min(bad, self.cyc.get(v, bad))
            for x, g, _, low, _ in self.outer.get(v, ()):
                self.frag_of[x] = g
                reach(x, low)
            for c, _, low, _ in self.links.get(v, ()):
                if c not in inside:
                    bad = min(bad, self.bad.get(c, bad))
                    for x, way in self.exits[c].items():
                        reach(x, min(low, way[3]))
        for v in part:
            self.roots[v], self.exits[v], self.bad[v], self.ring[v] = {}, exits, bad, name

    def _masks(self) -> dict[str, int]:
        """The local nodes that each node reaches, as bits."""
        number = {v: i for i, v in enumerate(self.nodes)}
        mask: dict[str, int] = {}
        for part in self.parts:
            inside, m, ring = set(part), 0, False
            for v in part:
                for c, *_ in self.links.get(v, ()):
                    if c in inside:
                        ring = True
                    else:
                        m |= mask[c] | 1 << number[c]
            if ring:
                for v in part:
                    m |= 1 << number[v]
            for v in part:
                mask[v] = m
        return mask

    def counts(self) -> pd.DataFrame:
        """(name, reached): how many other local nodes each node reaches, if any."""
        mask, number = self._masks(), {v: i for i, v in enumerate(self.nodes)}
        rows = [(v, (m & ~(1 << number[v])).bit_count()) for v, m in mask.items()]
        return pd.DataFrame([r for r in rows if r[1]], columns=["name", "reached"])

    def reach(self, everything: bool) -> pd.DataFrame:
        """Rows (f, src, kind, dst): local nodes (``in``) and exits (``link``) that
        each node, or each entry only, reaches."""
        mask = self._masks()
        out: list[tuple] = []
        for v in self.nodes:
            if everything or v in self.entries:
                m = mask[v]
                while m:
                    low = m & -m
                    out.append((self.fragment, v, "in", self.nodes[low.bit_length() - 1]))
                    m ^= low
                out += [(self.fragment, v, "link", x) for x in self.exits[v]]
        return pd.DataFrame(out, columns=["f", "src", "kind", "dst"])

    def _path(self, v: str, end: str, table: dict[str, dict]) -> list[str]:
        out: list[str] = []
        while v is not None:
            _, child, path = table[v][end][:3]
            out += path
            v = child
        return out

    def _marked(self) -> dict[str, str]:
        """Nodes on cycles: local ones, and those between an entry and an exit of
        one component of the quotient."""
        ring = dict(self.ring)
        for label, (entries, exits) in self.labels.items():
            if not entries or not exits:
                continue
            seen, todo = set(entries), list(entries)
            while todo:
                v = todo.pop()
                for c, *_ in self.links.get(v, ()):
                    if c not in seen:
                        seen.add(c)
                        todo.append(c)
            for v in seen:
                if v in self.exits and any(x in self.exits[v] for x in exits):
                    ring[v] = label
        return ring

    def rows(self, everything: bool, paths: bool) -> pd.DataFrame:
        out: list[tuple] = []
        f = self.fragment
        ring = self._marked() if everything else {}
        for v in self.nodes:
            if not everything and v not in self.entries:
                continue
            if v in ring:
                out.append((f, v, "on", None, None, None, ring[v], None))
            if v in self.bad:
                out.append((f, v, "cyc", None, None, None, self.bad[v], None))
            for r, way in self.roots[v].items():
                out.append((f, v, "root", r, None, way[0], None, self._path(v, r, self.roots) if paths else None))
            for x, way in self.exits[v].items():
                path = None if not paths else [x] if v in self.bad else self._path(v, x, self.exits)
                out.append((f, v, "link", x, self.frag_of[x], way[0], way[3], path))
        table = pd.DataFrame(out, columns=["f", "src", "kind", "dst", "g", "dist", "low", "path"])
        return table.astype({"g": "Int32", "dist": "Int64"})


def _entries(rows: DataFrame) -> DataFrame:
    cross = rows.where("kind = 'link' and f <> g").select(F.col("g").alias("f"), F.col("dst").alias("src")).distinct()
    return _padded(cross, "entry")


def _padded(df: DataFrame, kind: str, low: str | None = None) -> DataFrame:
    null = F.lit(None)
    return df.select(
        "f", "src", F.lit(kind).alias("kind"), null.cast("string").alias("dst"), null.cast("int").alias("g"), null.cast("bigint").alias("dist"),
        (F.col(low) if low else null.cast("string")).alias("low"), null.cast("array<string>").alias("path"),
    )


def _contract(rows: DataFrame, size: tuple[int, int, bool], fragment_nodes: int, paths: bool) -> tuple[DataFrame, tuple[int, int, bool]]:
    """The quotient's rows and its size: fragments, nodes, whether they lie by their links."""
    fragments, before, near = size
    small = cut(rows.unionByName(_entries(rows)).groupBy("f").applyInPandas(lambda x: _Local(x, paths).rows(False, paths), _ROWS))
    nodes = small.select("f", "src").distinct()
    count = nodes.count()
    if count <= 2 * fragment_nodes:
        placed, fragments, near = nodes.select("src", F.lit(0).alias("_f")), 1, False
    elif 2 * count <= before:
        # neighbours merge while they fit: one row per fragment is summed up
        per = nodes.groupBy("f").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.orderBy("f").rowsBetween(W.unboundedPreceding, -1))
        wider = per.withColumn("_upto", F.coalesce(upto, F.lit(0))).select("f", F.expr(f"_upto div {fragment_nodes}").cast("int").alias("_f"))
        placed, fragments, near = nodes.join(wider, "f").select("src", "_f"), -(-count // fragment_nodes), False
    elif near and 4 * count > 3 * before:
        # nothing left to contract between so many: larger fragments
        placed, fragments = nodes.select("src", F.expr("f div 2").alias("_f")), -(-fragments // 2)
    else:
        by_link, fragments = _place(_gathered(small, nodes, fragments), -(-count // fragment_nodes))
        placed, near = by_link.select(F.col("name").alias("src"), F.col("f").alias("_f")), True
    placed = cut_plain(placed) if fragments > 1 else placed
    moved = small.drop("f").join(placed, "src").withColumnRenamed("_f", "f")
    target = placed.select(F.col("src").alias("dst"), F.col("_f").alias("_g"))
    linked = moved.where("kind = 'link'").drop("g").join(target, "dst").withColumnRenamed("_g", "g")
    moved = moved.where("kind <> 'link'").unionByName(linked)
    return (cut_plain(moved) if fragments > 1 else moved), (fragments, count, near)


def _gathered(small: DataFrame, nodes: DataFrame, salt: int) -> DataFrame:
    """(name, place): nodes whose ways lead to one head within a bounded number of steps
    have one place."""
    up = small.where("kind = 'link'").groupBy("src").agg(F.min("dst").alias("up"))
    head = F.pmod(F.xxhash64("src", F.lit(salt)), F.lit(HEADS)) == 0
    at = nodes.select("src").join(up, "src", "left").select("src", F.when(head, F.col("src")).otherwise(F.coalesce("up", "src")).alias("at"))
    for _ in range(DOUBLINGS):
        at = cut_plain(at)
        at = at.join(at.select(F.col("src").alias("at"), F.col("at").alias("next")), "at").select("src", F.col("next").alias("at"))
    return cut_plain(at).select(F.col("src").alias("name"), F.xxhash64("at").cast("double").alias("place"))


def _solve(rows: DataFrame, size: tuple[int, int, bool], fragment_nodes: int, paths: bool) -> DataFrame:
    """(src, kind, dst, dist, low, scc, path): kind ``root`` per root reached, or
    one ``cyc`` row with the least name on a reachable cycle (low) and the label of
    the node's own cycle (scc, null off the cycles)."""
    if size[0] <= 1:
        local = cut(rows.groupBy("f").applyInPandas(lambda x: _Local(x, paths).rows(True, paths), _ROWS))
        return _settle(local.where("kind in ('root', 'cyc', 'on')").select("src", "kind", "dst", "dist", "low", "path"))
    quotient, smaller = _contract(rows, size, fragment_nodes, paths)
    solved = _solve(quotient, smaller, fragment_nodes, paths)
    solved = cut(solved) if smaller[0] > 1 else solved  # one fragment's rows are kept already
    labels = solved.where("kind = 'cyc' and scc is not null").select(F.col("src").alias("name"), F.col("scc").alias("label"))
    cross = rows.where("kind = 'link' and f <> g")
    exits = cross.select("f", F.col("dst").alias("name")).distinct().join(labels, "name").select("f", F.col("name").alias("src"), "label")
    entries = _entries(rows).select("f", F.col("src").alias("name")).join(labels, "name").select("f", F.col("name").alias("src"), "label")
    told = rows.unionByName(_padded(entries, "in", "label")).unionByName(_padded(exits, "out", "label"))
    local = cut(told.groupBy("f").applyInPandas(lambda x: _Local(x, paths).rows(True, paths), _ROWS))
    own = local.where("kind in ('root', 'cyc', 'on')").select("src", "kind", "dst", "dist", "low", "path")
    a, b = local.where("kind = 'link'").alias("a"), solved.alias("b")
    beyond = a.join(b, F.col("a.dst") == F.col("b.src")).select(
        F.col("a.src").alias("src"),
        F.col("b.kind").alias("kind"),
        F.col("b.dst").alias("dst"),
        (F.col("a.dist") + F.col("b.dist")).alias("dist"),
        F.col("b.low").alias("low"),
        F.concat("a.path", "b.path").alias("path"),
    )
    return _settle(own.unionByName(beyond))


def _settle(rows: DataFrame) -> DataFrame:
    cyc = rows.where("kind in ('cyc', 'on')").groupBy("src").agg(
        F.min(F.when(F.col("kind") == "cyc", F.col("low"))).alias("low"), F.min(F.when(F.col("kind") == "on", F.col("low"))).alias("scc")
    )
    roots = rows.where("kind = 'root'").join(cyc, "src", "left_anti").groupBy("src", "dst").agg(F.min(F.struct((-F.col("dist")).alias("minus"), "path")).alias("x"))
    null = F.lit(None).cast("string")
    return roots.select("src", F.lit("root").alias("kind"), "dst", (-F.col("x.minus")).alias("dist"), null.alias("low"), null.alias("scc"), "x.path").unionByName(
        cyc.select("src", F.lit("cyc").alias("kind"), null.alias("dst"), F.lit(None).cast("bigint").alias("dist"), "low", "scc", F.lit(None).cast("array<string>").alias("path"))
    )


def _fragments(nodes: DataFrame, links: DataFrame, fragment_nodes: int, least_nodes: int = LEAST_NODES) -> tuple[DataFrame, tuple[int, int, bool]]:
    """Rows of all nodes and links, by fragment of their source; and the size. There are
    as many fragments as their bound asks for, or as there are tasks to work on them."""
    nodes = cut(nodes.where(F.col("name").isNotNull()).groupBy("name").agg(F.min(F.coalesce("place", F.lit(0)).cast("double")).alias("place")))
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    count, bounds = nodes.agg(F.count("*"), F.percentile_approx("place", shares, 100 * QUANTILES)).first()
    fragments = max(1, -(-count // fragment_nodes), min(shuffle_partitions(nodes.sparkSession), count // least_nodes))
    bounds = sorted({bounds[i * QUANTILES // fragments - 1] for i in range(1, fragments)}) if 1 < fragments <= QUANTILES else []
    if len(bounds) + 1 == fragments:
        above = F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("place")) if bounds else F.array()
        placed = nodes.select("name", F.size(above).alias("f"))
    else:
        placed, fragments = _place(nodes, fragments)
    named = links.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()
    to = named.join(placed.select(F.col("name").alias("dst"), F.col("f").alias("g")), "dst")
    full = placed.withColumnRenamed("name", "src").join(to, "src", "left")
    linked = F.col("dst").isNotNull()
    rows = full.select(
        "f",
        "src",
        F.when(linked, F.lit("link")).otherwise(F.lit("root")).alias("kind"),
        F.coalesce("dst", "src").alias("dst"),
        "g",
        F.when(linked, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("dist"),
        F.col("src").alias("low"),
        F.when(linked, F.array("dst")).otherwise(F.array().cast("array<string>")).alias("path"),
    )
    return cut(rows), (fragments, count, False)


def _place(nodes: DataFrame, fragments: int) -> tuple[DataFrame, int]:
    """(name, f): ranges of the place, and of the name where many share one place.
    Spark samples the bounds; the checkpoint fixes who lies where."""
    if fragments <= 1:
        return nodes.select("name", F.lit(0).alias("f")), 1
    ranged = nodes.repartitionByRange(fragments, "place", "name")
    return cut(ranged.select("name", F.spark_partition_id().alias("f"))), fragments


def hierarchies(nodes: DataFrame, links: DataFrame, fragment_nodes: int = FRAGMENT_NODES, paths: bool = True, least_nodes: int = LEAST_NODES) -> DataFrame:
    """(node, root, depth, path, cycle) from nodes (name, place) and links (src, dst).

    ``place`` is any number that orders nodes so that related ones are near (load
    order); it only affects speed. ``path`` runs from below the node to the root; it
    is null where ``paths`` is off, and then nothing grows with the depth. Nodes from which a cycle can be reached have one row: root = the least name on
    such a cycle, depth -1 on a cycle and -2 otherwise, no path; nodes of one cycle
    (strongly connected component) share a value of ``cycle``.
    """
    solved = _solve(*_fragments(nodes, links, fragment_nodes, least_nodes), fragment_nodes, paths)
    cyc = F.col("kind") == "cyc"
    return solved.select(
        F.col("src").alias("node"),
        F.when(cyc, F.col("low")).otherwise(F.col("dst")).alias("root"),
        F.when(cyc, F.when(F.col("scc").isNotNull(), F.lit(-1)).otherwise(F.lit(-2))).otherwise(F.col("dist")).cast("bigint").alias("depth"),
        "path",
        F.col("scc").alias("cycle"),
    )


def _reach(rows: DataFrame, size: tuple[int, int, bool], fragment_nodes: int) -> DataFrame:
    shape = "f int, src string, kind string, dst string"
    local = rows.groupBy("f").applyInPandas(lambda x: _Local(x).reach(True), shape)
    if size[0] <= 1:
        return local.select("src", "dst").distinct()
    beyond = cut(_reach(*_contract(rows, size, fragment_nodes, False), fragment_nodes))
    local = cut(local)
    inner = local.where("kind = 'in'").select("src", "dst")
    exits = local.where("kind = 'link'").select("src", F.col("dst").alias("x"))
    far = exits.join(beyond.select(F.col("src").alias("x"), "dst"), "x").select("src", F.col("dst").alias("x"))
    doors = exits.unionByName(far).distinct()
    through = doors.join(inner.select(F.col("src").alias("x"), "dst"), "x").select("src", "dst")
    return inner.unionByName(doors.select("src", F.col("x").alias("dst"))).unionByName(through).distinct()


def reachability(nodes: DataFrame, links: DataFrame, fragment_nodes: int = FRAGMENT_NODES, least_nodes: int = LEAST_NODES) -> DataFrame:
    """(src, dst): every node with every node it reaches over one or more links,
    by the same contraction; a node reaches itself only on a cycle."""
    return _reach(*_fragments(nodes, links, fragment_nodes, least_nodes), fragment_nodes)


def reach_counts(nodes: DataFrame, links: DataFrame, fragment_nodes: int = FRAGMENT_NODES) -> DataFrame:
    """(name, reached): how many other nodes each node reaches, for those that reach any.
    In one fragment no pair leaves the task."""
    rows, size = _fragments(nodes, links, fragment_nodes, fragment_nodes)
    if size[0] <= 1:
        return rows.groupBy("f").applyInPandas(lambda x: _Local(x).counts(), "name string, reached bigint")
    pairs = _reach(rows, size, fragment_nodes).where("src <> dst")
    return pairs.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("reached"))


def descendants(nodes: DataFrame, links: DataFrame, fragment_nodes: int = FRAGMENT_NODES, least_nodes: int = LEAST_NODES) -> DataFrame:
    """(node, descendant): links run from child to parent."""
    return reachability(nodes, links, fragment_nodes, least_nodes).select(F.col("dst").alias("node"), F.col("src").alias("descendant"))


def _flood(rows: pd.DataFrame) -> pd.DataFrame:
    """What a fragment's starts reach over its links: nodes (``in``) and exits."""
    links: dict[str, list[str]] = {}
    outer: dict[str, list[str]] = {}
    seeds: set[str] = set()
    for f, src, kind, dst, g in zip(*(rows[c].tolist() for c in ("f", "src", "kind", "dst", "g"))):
        if kind == "start":
            seeds.add(src)
        elif kind == "link":
            (links if g == f else outer).setdefault(src, []).append(dst)
    reached, exits, todo = set(), set(), list(seeds)
    while todo:
        v = todo.pop()
        exits.update(outer.get(v, ()))
        for c in links.get(v, ()):
            if c not in reached:
                reached.add(c)
                if c not in seeds:
                    todo.append(c)
    return pd.DataFrame([(x, "in") for x in reached] + [(x, "link") for x in exits], columns=["src", "kind"])


def _flooded(rows: DataFrame, size: tuple[int, int, bool], fragment_nodes: int, starts: DataFrame) -> DataFrame:
    def run(more: DataFrame) -> DataFrame:
        told = rows.unionByName(_padded(more, "start"))
        return cut(told.groupBy("f").applyInPandas(_flood, "src string, kind string"))

    near = run(starts)
    if size[0] <= 1:
        return near.where("kind = 'in'").select("src").distinct()
    exits = near.where("kind = 'link'").select("src").distinct()
    quotient, wider = _contract(rows, size, fragment_nodes, False)
    beyond = _flooded(quotient, wider, fragment_nodes, exits.join(quotient.select("f", "src").distinct(), "src").select("f", "src"))
    doors = cut(exits.unionByName(beyond).distinct())
    inside = run(starts.unionByName(doors.join(rows.select("f", "src").distinct(), "src").select("f", "src")))
    return doors.unionByName(inside.where("kind = 'in'").select("src")).distinct()


def reached(nodes: DataFrame, links: DataFrame, starts: DataFrame, fragment_nodes: int = FRAGMENT_NODES) -> DataFrame:
    """(name) of all nodes reached from ``starts`` (name) over one or more links. The
    result and all between grow with the nodes, not with pairs of them."""
    rows, size = _fragments(nodes, links, fragment_nodes)
    placed = rows.select("f", "src").distinct().join(starts.select(F.col("name").alias("src")).distinct(), "src", "left_semi").select("f", "src")
    return _flooded(rows, size, fragment_nodes, placed).select(F.col("src").alias("name"))
