"""Selecting nodes: exact and regular patterns, tags, globs and small predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import col


def split_pattern(pattern: str) -> tuple[str, str]:
    """Both sides of ``cookbook:recipe``, split at the first colon; an empty side
    stands for anything."""
    if ":" not in pattern:
        raise ValueError(f"pattern {pattern!r} needs a ':'")
    left, _, right = pattern.partition(":")
    return left, right


def select_exact(nodes: DataFrame, pattern: str) -> DataFrame:
    left, right = split_pattern(pattern)
    cond = F.lit(True)
    for value, name in ((left, "cookbook"), (right, "recipe")):
        if value:
            cond = cond & (F.col(name) == value)
    return nodes.where(cond)


def check_regex(pattern: str) -> str:
    """Only what all common dialects share: no look-around and no back-references."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?P=|\\k<", pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern!r}")
    re.compile(pattern)
    return pattern


def select_regex(nodes: DataFrame, pattern: str) -> DataFrame:
    """Each side is searched, unanchored, in its column."""
    left, right = split_pattern(pattern)
    cond = F.lit(True)
    for value, name in ((left, "cookbook"), (right, "recipe")):
        if value:
            cond = cond & F.col(name).rlike(check_regex(value))
    return nodes.where(cond)


def select_tags(nodes: DataFrame, tags: list[str]) -> DataFrame:
    """Nodes with any of the tags, whatever the case; no tags filter nothing."""
    if not tags:
        return nodes
    wanted = F.array(*[F.lit(t.lower()) for t in tags])
    return nodes.where(F.coalesce(F.arrays_overlap(F.transform("tags", F.lower), wanted), F.lit(False)))


def select(nodes: DataFrame, pattern: str | None = None, regex: bool = False, tags: list[str] = ()) -> DataFrame:
    """Pattern first, then tags; a selection may be empty."""
    if pattern:
        nodes = select_regex(nodes, pattern) if regex else select_exact(nodes, pattern)
    return select_tags(nodes, list(tags))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: ``*`` and ``?`` stop at ``/``,
    ``**`` crosses it, ``[...]`` and ``{a,b}`` as usual."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = j
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_glob(path: Column | str, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return F.coalesce(col(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)), F.lit(False))


def normal_pattern(pattern: str, base: str) -> str:
    """Trimmed, one layer of quotes off, absolute below ``base``, ``.`` and ``..``
    of the part before the first wildcard resolved."""
    p = pattern.strip()
    if len(p) >= 2 and p[0] == p[-1] and p[0] in "'\"":
        p = p[1:-1]
    if not p.startswith("/"):
        p = base.rstrip("/") + "/" + p
    parts = p.split("/")
    wild = next((i for i, x in enumerate(parts) if re.search(r"[*?\[{]", x)), len(parts))
    head: list[str] = []
    for x in parts[:wild]:
        if x == "..":
            head = head[:-1]
        elif x not in ("", "."):
            head.append(x)
    return "/" + "/".join(head + parts[wild:])


def blank_run(nodes: DataFrame) -> DataFrame:
    """Nodes whose ``run`` is null or blank: they fail validation."""
    return nodes.where(F.coalesce(F.trim(F.regexp_replace("run", r"\s+", " ")), F.lit("")) == "")


def has_template(text: Column | str) -> Column:
    return F.contains(col(text), F.lit("{{")) & F.contains(col(text), F.lit("}}"))


def needs_restore(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """Outputs (path, size, ...) whose file is absent or of another size."""
    there = files.groupBy("path").agg(F.max("size").alias("_there"))
    joined = outputs.join(there, "path", "left")
    return joined.where(F.col("_there").isNull() | ~F.col("_there").eqNullSafe(F.col("size"))).drop("_there")


def due(last: Column | str, now: Column | str, days: int, forced: bool = False) -> Column:
    """Whether whole days since ``last`` (epoch seconds) reach the interval."""
    if forced:
        return F.lit(True)
    return col(last).isNull() | (F.floor((col(now) - col(last)) / F.lit(86_400)) >= days)


def key_value(text: Column | str) -> Column:
    """struct(key, value) of ``key=value``, split at the first ``=``; else null."""
    parts = F.split(col(text), "=", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("key"), parts[1].alias("value")))


def parse_key_values(items: list[str]) -> dict[str, str]:
    out = {}
    for item in items:
        key, sep, value = item.partition("=")
        if not sep:
            raise ValueError(f"{item!r} is not key=value")
        out[key] = value
    return out


def override_names(overrides: DataFrame, column: str = "overrides") -> DataFrame:
    """Distinct environment names over map-typed overrides."""
    return overrides.select(F.explode(F.map_keys(column)).alias("environment")).distinct()
