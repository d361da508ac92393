"""Dependency graphs as DataFrames: nodes (fqn, cookbook, dependencies, ...) and
edges (src, dst), where src depends on dst.

Recursive results come from the contraction operator in :mod:`hierarchy`, which
takes a number of jobs that grows with the logarithm of the graph, not with its
depth. Repeated edges change no level or closure but count in fingerprints.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import blake3
from ..functions.digests import trimmed
from ..session import cut, cut_plain
from . import hierarchy


def _named(rows: DataFrame, column: str, shown: int = 20) -> str:
    """The least names, and how many more there are; empty if there are none."""
    first = [r[0] for r in rows.select(column).distinct().orderBy(column).limit(shown + 1).collect()]
    more = rows.select(column).distinct().count() - shown if len(first) > shown else 0
    return ", ".join(map(str, first[:shown])) + (f" and {more} more" if more else "")


class CycleError(ValueError):
    """The graph has a cycle; the message lists its nodes."""


class UnknownTarget(ValueError):
    """A target is no node of the graph."""


def fqn(cookbook: str = "cookbook", recipe: str = "recipe"):
    return F.concat(F.col(cookbook), F.lit(":"), F.col(recipe))


def qualified(dependency, cookbook):
    """A dependency without ``:`` means the own cookbook."""
    return F.when(F.contains(dependency, F.lit(":")), dependency).otherwise(F.concat(cookbook, F.lit(":"), dependency))


def references(nodes: DataFrame) -> DataFrame:
    """(src, dst) per entry of ``dependencies``, with multiplicity; blanks dropped."""
    own = F.substring_index("fqn", ":", 1)
    named = F.transform(F.filter(F.transform("dependencies", trimmed), lambda x: x.isNotNull() & (x != "")), lambda x: qualified(x, own))
    return nodes.select(F.col("fqn").alias("src"), F.explode(named).alias("dst"))


def edges(nodes: DataFrame) -> DataFrame:
    """References whose target exists."""
    return references(nodes).join(nodes.select(F.col("fqn").alias("dst")), "dst", "left_semi").select("src", "dst")


def missing_dependencies(nodes: DataFrame) -> DataFrame:
    """(src, dst) of every reference whose target does not exist."""
    return references(nodes).join(nodes.select(F.col("fqn").alias("dst")), "dst", "left_anti").select("src", "dst").distinct()


def unknown_targets(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    return targets.join(nodes.select("fqn"), "fqn", "left_anti")


def subgraph(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links with both ends in ``targets`` (fqn)."""
    return links.join(targets.select(F.col("fqn").alias("src")), "src", "left_semi").join(targets.select(F.col("fqn").alias("dst")), "dst", "left_semi").select("src", "dst")


def _placed(nodes: DataFrame) -> DataFrame:
    place = F.col("place") if "place" in nodes.columns else F.pmod(F.xxhash64(F.substring_index("fqn", ":", 1)), F.lit(1 << 30))
    return nodes.select(F.col("fqn").alias("name"), place.alias("place"))


def cycles(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cycle, fqn): strongly connected components of several nodes or a self-link."""
    return hierarchy.hierarchies(_placed(nodes), links, paths=False).where("depth = -1").select("cycle", F.col("node").alias("fqn"))


def levels(nodes: DataFrame, links: DataFrame, strict: bool = False) -> DataFrame:
    """(level, fqn): level 0 has no dependencies, others are one above their highest.

    Nodes that reach a cycle have no level; ``strict`` raises on them instead.
    """
    solved = hierarchy.hierarchies(_placed(nodes), links, paths=False)
    if strict:
        bad = _named(solved.where("depth = -1"), "node")
        if bad:
            raise CycleError("cycle through " + bad)
    return solved.where("depth >= 0").groupBy(F.col("node").alias("fqn")).agg(F.max("depth").alias("level")).select("level", "fqn")


def plan_statistics(plan: DataFrame) -> DataFrame:
    """(recipes, levels, widest) of a plan (level, fqn)."""
    per = plan.groupBy("level").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("recipes"), F.count("*").alias("levels"), F.coalesce(F.max("n"), F.lit(0)).alias("widest"))


def closure_of(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(fqn) reached from ``starts`` over one or more links."""
    ends = links.select(F.col("src").alias("fqn")).unionByName(links.select(F.col("dst").alias("fqn"))).distinct()
    found = hierarchy.reached(_placed(ends), links, starts.select(F.col("fqn").alias("name")))
    return found.select(F.col("name").alias("fqn"))


def transitive_dependencies(start: str, links: DataFrame) -> DataFrame:
    """Everything ``start`` depends on, itself excluded; an unknown start has none."""
    one = links.sparkSession.createDataFrame([(start,)], "fqn string")
    return closure_of(one, links).where(F.col("fqn") != start)


def all_dependencies(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): the closure of every node at once, itself excluded."""
    return hierarchy.reachability(_placed(nodes), links).where("src <> dst")


def dependency_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(fqn, dependencies): the size of every node's closure, itself excluded. A graph of
    one fragment is counted by bit masks; a larger one over its distinct pairs."""
    return hierarchy.reach_counts(_placed(nodes), links).select(F.col("name").alias("fqn"), F.col("reached").alias("dependencies"))


def plan_for(targets: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(level, fqn) of the targets and all they depend on; unknown targets raise."""
    unknown = _named(unknown_targets(targets, nodes), "fqn")
    if unknown:
        raise UnknownTarget("unknown: " + unknown)
    wanted = cut(targets.select("fqn").unionByName(closure_of(targets, links)).distinct())
    return levels(nodes.join(wanted, "fqn", "left_semi"), subgraph(links, wanted), strict=True)


def added(new: DataFrame, old: DataFrame) -> DataFrame:
    """Names of ``new`` that ``old`` lacks."""
    return new.select("fqn").distinct().join(old.select("fqn"), "fqn", "left_anti")


def materialize(plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """The plan with the full records of its nodes."""
    return plan.join(nodes, "fqn")


def _hash_fragment(rows: pd.DataFrame) -> pd.DataFrame:
    """Fingerprints of all nodes of a fragment (rows with ``self_hash``), wave by wave;
    the other rows are known ones of other fragments."""
    known = {n: h for n, h, own in zip(rows["fqn"], rows["known"], rows["self_hash"]) if own is None}
    todo = {n: (own, list(d)) for n, own, d in zip(rows["fqn"], rows["self_hash"], rows["deps"]) if own is not None}
    waiting: dict[str, int] = {}
    users: dict[str, list[str]] = {}
    for n, (_, deps) in todo.items():
        open_ = {d for d in deps if d not in known}
        waiting[n] = len(open_)
        for d in open_:
            users.setdefault(d, []).append(n)
    ready, out = [n for n, w in waiting.items() if not w], []
    while ready:
        texts = [(todo[n][0] + "".join(sorted(known[d] for d in todo[n][1]))).encode() for n in ready]
        wave = list(zip(ready, blake3.digests(texts)))
        known.update(wave)
        out += wave
        ready = []
        for n, _ in wave:
            for u in users.get(n, ()):
                waiting[u] -= 1
                if not waiting[u]:
                    ready.append(u)
    return pd.DataFrame(out, columns=["fqn", "fingerprint"])


def _bands(plan: DataFrame, fragment_nodes: int) -> DataFrame:
    """(band, level, wide): successive levels of together about a fragment of nodes are a
    band; a level of more nodes is one of its own. One row per level is summed up."""
    per = plan.groupBy("level").agg(F.count("*").alias("n"))
    w = W.orderBy("level")
    wide = F.col("n") > fragment_nodes
    slot = F.expr(f"coalesce(sum(n) over (order by level rows between unbounded preceding and 1 preceding), 0) div {fragment_nodes}")
    marked = per.select("level", wide.alias("wide"), slot.alias("slot"))
    new = F.col("wide") | F.coalesce(F.lag("wide").over(w) | (F.lag("slot").over(w) != F.col("slot")), F.lit(True))
    return marked.withColumn("new", new.cast("int")).select(F.sum("new").over(w).alias("band"), "level", "wide")


def fingerprints(nodes: DataFrame, links: DataFrame, fragment_nodes: int = hierarchy.FRAGMENT_NODES) -> DataFrame:
    """(fqn, fingerprint): BLAKE3 over the node's ``self_hash`` followed by the
    sorted fingerprints of its direct dependencies (with multiplicity).

    Each node is hashed once, in the order of its level. A graph of one fragment is one
    task; otherwise narrow levels are taken together, a fragment of nodes in a task, and
    wide ones in as many tasks as they fill. Nodes that reach a cycle have no fingerprint.
    """
    deps = links.groupBy("src").agg(F.collect_list("dst").alias("deps"))
    base = nodes.select("fqn", "self_hash").join(deps.withColumnRenamed("src", "fqn"), "fqn", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
    base, none = cut(base), F.lit(None).cast("string")
    shape = "fqn string, fingerprint string"
    if base.count() <= fragment_nodes:
        return base.select("*", none.alias("known"), F.lit(0).alias("f")).groupBy("f").applyInPandas(_hash_fragment, shape)
    plan = cut(levels(nodes, links))
    bands = cut(_bands(plan, fragment_nodes))
    base = cut(base.join(plan, "fqn").join(bands, "level"))
    done: DataFrame | None = None
    # a round per band: at most two for every fragment of nodes, and no more than levels
    for band, wide in sorted((r.band, r.wide) for r in bands.select("band", "wide").distinct().collect()):
        mine = base.where(F.col("band") == band)
        part = F.pmod(F.xxhash64("fqn"), F.lit(-(-mine.count() // fragment_nodes))) if wide else F.lit(0)
        rows = mine.select(part.alias("f"), "fqn", "self_hash", "deps", none.alias("known"))
        if done is not None:
            asked = rows.select("f", F.explode("deps").alias("fqn")).distinct()
            told = asked.join(done, "fqn").select("f", "fqn", none.alias("self_hash"), F.lit(None).cast("array<string>").alias("deps"), F.col("fingerprint").alias("known"))
            rows = rows.unionByName(told)
        new = cut_plain(rows.groupBy("f").applyInPandas(_hash_fragment, shape))
        done = new if done is None else done.unionByName(new)
    return done
