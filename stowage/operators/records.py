"""Hashes of node records over all that their results depend on.

A record's canonical text is JSON with sorted keys and no spaces: ``environment``
(the named variables with their values, unset ones empty), ``file_hashes`` (the
digest of every file that a pattern of ``cache.inputs`` matches, by its path
relative to the record's folder), ``run``, ``tags`` in their order, ``variables``.
Its BLAKE3 is the record's own hash, the input of :func:`graph.fingerprints`.

Scale: patterns meet files by an equi-join on the folder before the first wildcard,
of which a file has as many as it lies deep; each distinct pattern is matched once,
however many records use it. The text of one record is made by one task, since its
hash is one over all of it.

Defined results: null lists and maps are empty ones, a null ``run`` is empty, null
values are empty texts; repeated names and patterns count once; a file that several
patterns match counts once; records without files or variables have empty objects.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blake3
from .selection import glob_regex, normal_pattern


def _absolute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(base, pattern) to the folder before the first wildcard and the expression."""
    for batch in batches:
        base, pattern = batch.column("base").to_pylist(), batch.column("pattern").to_pylist()
        whole = [normal_pattern(p, "/" + b.strip("/")) for b, p in zip(base, pattern)]
        heads = []
        for w in whole:
            parts = w.split("/")
            wild = next((i for i, x in enumerate(parts) if any(c in x for c in "*?[{")), len(parts) - 1)
            heads.append("/".join(parts[:wild]))
        cols = [base, pattern, heads, [glob_regex(w) for w in whole]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["base", "pattern", "head", "regex"])


def _relative(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, path = batch.column("base").to_pylist(), batch.column("path").to_pylist()
        names = [posixpath.relpath(p, "/" + b.strip("/")) for b, p in zip(base, path)]
        yield pa.RecordBatch.from_arrays([batch.column("base"), batch.column("pattern"), pa.array(names, pa.string()), batch.column("digest")], names=["base", "pattern", "name", "digest"])


def input_files(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """(fqn, name, digest) of the files (path, digest) that a pattern (fqn, base,
    pattern) matches; ``base`` is the record's folder, ``name`` is relative to it."""
    known = patterns.where("fqn is not null and pattern is not null").select("fqn", F.coalesce("base", F.lit("")).alias("base"), "pattern").distinct()
    made = known.select("base", "pattern").distinct().mapInArrow(_absolute, "base string, pattern string, head string, regex string")
    path = F.concat(F.lit("/"), F.regexp_replace("path", "^/+", ""))
    whole = files.where("path is not null").select(path.alias("path"), "digest")
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    lying = whole.withColumn("head", F.explode(folders))
    hit = made.join(lying, "head").where(F.rlike("path", F.col("regex"))).select("base", "pattern", "path", "digest")
    named = hit.mapInArrow(_relative, "base string, pattern string, name string, digest string")
    return known.join(named, ["base", "pattern"]).select("fqn", "name", "digest").distinct()


def canonical(environment: dict, files: dict, run: str, tags: list, variables: dict) -> str:
    def ordered(x: dict, key=None) -> dict:
        return {k: x[k] for k in sorted(x, key=key)}

    record = {"environment": ordered(environment), "file_hashes": ordered(files, lambda p: p.split("/")), "run": run, "tags": tags, "variables": ordered(variables)}
    return json.dumps(record, ensure_ascii=False, separators=(",", ":"))


def record_texts(nodes: DataFrame, files: DataFrame | None = None, values: dict[str, str] | None = None, hashed: bool = False) -> DataFrame:
    """(fqn, record) of nodes (fqn, environment, run, tags, variables), with their input
    files (fqn, name, digest) and the values of environment names; and, where ``hashed``,
    ``self_hash``."""
    values = dict(values or {})
    shape = "fqn string, record string" + (", self_hash string" if hashed else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for r in batch.select(["environment", "run", "tags", "variables", "files"]).to_pylist():
                env = {n: values.get(n, "") for n in r["environment"] or [] if n is not None}
                own = {k: "" if v is None else v for k, v in r["variables"] or []}
                texts.append(canonical(env, {f["name"]: f["digest"] for f in r["files"] or []}, r["run"] or "", [t for t in r["tags"] or [] if t is not None], own))
            cols = [batch.column("fqn"), pa.array(texts, pa.string())]
            if hashed:
                cols.append(pa.array(blake3.digests([t.encode() for t in texts]), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["fqn", "record", "self_hash"][: len(cols)])

    rows = nodes.select("fqn", "environment", "run", "tags", "variables")
    if files is None:
        rows = rows.withColumn("files", F.lit(None).cast("array<struct<name:string,digest:string>>"))
    else:
        per = files.groupBy("fqn").agg(F.collect_list(F.struct("name", "digest")).alias("files"))
        rows = rows.join(per, "fqn", "left")
    return rows.mapInArrow(run, shape)


def record_hashes(nodes: DataFrame, files: DataFrame | None = None, values: dict[str, str] | None = None) -> DataFrame:
    """(fqn, self_hash): BLAKE3 of the canonical texts."""
    return record_texts(nodes, files, values, hashed=True).select("fqn", "self_hash")
