"""From a selection to an execution plan, with templates resolved and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import col, trimmed
from . import graph, overlay, selection


class InvalidRecipe(ValueError):
    """A planned node without a command, or with an unknown template."""


def included(nodes: DataFrame, names: DataFrame | None) -> DataFrame:
    """Nodes named in ``names`` (fqn); none given, or an empty table, means all."""
    if names is None or names.isEmpty():
        return nodes
    return nodes.join(names.select("fqn"), "fqn", "left_semi")


def resolve_templates(nodes: DataFrame, templates: DataFrame) -> DataFrame:
    """Nodes that use a template, merged with it; others as they are. ``templates``:
    (name, and the columns description, dependencies, cache, run, environment,
    variables, tags). Unknown templates raise."""
    used = nodes.where("template is not null").withColumn("template", trimmed("template"))
    lost = graph._named(overlay.unknown_templates(used, templates), "template")
    if lost:
        raise InvalidRecipe("unknown templates: " + lost)
    parts = ("description", "dependencies", "cache", "run", "environment", "variables", "tags")
    t = templates.select(F.col("name").alias("template"), F.struct(*parts).alias("t"))
    joined = used.withColumn("n", F.struct(*parts)).join(t, "template")
    merged = overlay.merge_template("n", "t")
    return nodes.where("template is null").unionByName(joined.withColumns(merged).select(*nodes.columns))


def plan_selection(nodes: DataFrame, pattern: str | None = None, regex: bool = False, tags: list[str] = (), templates: DataFrame | None = None) -> DataFrame:
    """(level, fqn) of the selected nodes and all they need. A selection that matches
    nothing gives an empty plan; planned nodes must have a command once their
    templates are resolved, which may add dependencies."""
    picked = selection.select(nodes, pattern, regex, tags).select("fqn")
    if templates is not None:
        nodes = resolve_templates(nodes, templates)
    plan = graph.plan_for(picked, nodes, graph.edges(nodes))
    blank = graph._named(selection.blank_run(graph.materialize(plan, nodes)), "fqn")
    if blank:
        raise InvalidRecipe("no command: " + blank)
    return plan


def parallelism(wanted: Column | str, cores: Column | str, reserved: Column | str) -> Column:
    """Tasks at a time: what is wanted, within the cores that are not reserved, and
    at least one."""
    return F.greatest(F.lit(1), F.least(col(wanted), col(cores) - col(reserved)))


def text_lines(text: Column | str) -> Column:
    """Trimmed lines of a text, without blank ones."""
    return F.filter(F.transform(F.split(col(text), "\n"), trimmed), lambda x: x != "")
