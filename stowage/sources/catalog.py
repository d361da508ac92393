"""YAML catalogs of namespaces, nodes, templates and functions as DataFrames.

Files are listed by :mod:`walk`, which honours the ignore files of the tree; their
texts are rendered and parsed in Arrow batches, so a catalog of any number of files
is read in parallel. Names of files, those of ignore files too, are parameters.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from ..operators.selection import matches_glob
from . import walk

NODES = (
    "fqn string, cookbook string, recipe string, description string, tags array<string>, dependencies array<string>, "
    "environment array<string>, variables map<string,string>, run string, cache struct<inputs:array<string>,outputs:array<string>>, "
    "template string, parameters string, config_path string"
)
MINIMAL = ("fqn", "cookbook", "recipe", "description", "tags", "dependencies", "environment", "config_path")


class CatalogError(ValueError):
    """A catalog file that cannot be read."""


def _loader():
    """YAML with the core schema of version 1.2: only true/false and null words,
    no octal or sexagesimal numbers, no dates."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {}
    kinds = (
        ("null", r"^(?:~|null|Null|NULL|)$", list("~nN") + [""]),
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
        ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
    )
    for name, pattern, first in kinds:
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{name}", re.compile(pattern), first)
    Loader.add_constructor("tag:yaml.org,2002:int", lambda l, n: int(v[2:], 8) if (v := l.construct_scalar(n)).startswith("0o") else int(v, 16) if v.startswith("0x") else int(v))
    Loader.add_multi_constructor("!", lambda l, _, n: l.construct_mapping(n, True) if hasattr(n, "value") and n.id == "mapping" else l.construct_sequence(n, True) if n.id == "sequence" else l.construct_scalar(n))
    return Loader


def parse_yaml(text: str) -> Any:
    import yaml

    return yaml.load(text, _loader())


def to_json_value(v: Any) -> Any:
    """What JSON can hold: not-a-number and infinities become 0, keys that are no
    strings are dropped."""
    if isinstance(v, dict):
        return {k: to_json_value(x) for k, x in v.items() if isinstance(k, str)}
    if isinstance(v, list):
        return [to_json_value(x) for x in v]
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return 0
    return v


def locate(start: str, names: tuple[str, ...]) -> str:
    """The first of ``names`` in ``start`` or a folder above it; the search ends at
    the root or at a folder that holds ``.git``."""
    at = os.path.abspath(start)
    if os.path.isfile(at):
        return at
    while True:
        for n in names:
            if os.path.isfile(os.path.join(at, n)):
                return os.path.join(at, n)
        up = os.path.dirname(at)
        if up == at or os.path.isdir(os.path.join(at, ".git")):
            raise CatalogError(f"none of {', '.join(names)} at or above {start}")
        at = up


def read_project(path: str, names: tuple[str, ...], environment: str | None = None, command: dict[str, str] | None = None, env: dict[str, str] | None = None) -> dict:
    """The root record: variables first (with the environment's overrides), then the
    text rendered with them, then parsed."""
    found = locate(path, names) if os.path.isdir(path) else path
    if not os.path.exists(found):
        raise CatalogError(f"no file {found}")
    with open(found, encoding="utf-8") as f:
        text = f.read()
    scope = {"project": {"root": os.path.dirname(os.path.abspath(found))}, "env": env or {}}
    variables = text_variables(text, scope, environment, command)
    out = parse_yaml(render.render(text, scope | {"var": variables}))
    if not isinstance(out, dict) or not out.get("name"):
        raise CatalogError(f"{found}: name is required")
    return to_json_value(out) | {"variables": variables}


def text_variables(text: str, scope: dict, environment: str | None, command: dict[str, str] | None) -> dict:
    """The top-level ``variables`` and the environment's ``overrides`` of a file that
    is itself a template."""
    blocks = {n: parse_yaml(b).get(n) or {} if (b := block(text, n)) else {} for n in ("variables", "overrides")}
    out = render.process(blocks["variables"], scope)
    if environment and blocks["overrides"].get(environment):
        out |= render.process(blocks["overrides"][environment], scope | {"var": out})
    return out | {k: render.retyped(v) for k, v in (command or {}).items()}


def block(text: str, name: str) -> str | None:
    """The lines of the top-level block ``name``, before any rendering."""
    out: list[str] = []
    for line in text.splitlines():
        if out:
            if line.strip() and not line.lstrip().startswith("#") and not line[0].isspace():
                break
            out.append(line)
        elif line.startswith(name + ":"):
            out.append(line)
    return "\n".join(out) if out else None


def ignored(path: str, patterns: list[str]) -> bool:
    """Whether ignore lines tied to the root leave a file out, or a folder above it."""
    rules = [("", x) for x in patterns]
    parts = path.strip("/").split("/")
    return any(walk.left_out("/" + "/".join(parts[: n + 1]), n + 1 < len(parts), rules) for n in range(len(parts)))


def read_texts(spark: SparkSession, root: str, pattern: str, ignore: list[str] = (), ignore_files: tuple[str, ...] = (walk.GIT_IGNORE,)) -> DataFrame:
    """(path, text) of all files below ``root`` whose name matches; hidden ones, and
    those that the tree's ignore files or ``ignore`` leave out, are not read; a missing
    folder is empty."""
    files = walk.list_files(spark, root, hidden=False, ignore_files=ignore_files, ignore=list(ignore))
    named = files.where(matches_glob(F.substring_index("path", "/", -1), [pattern]))
    return walk.with_contents(named.select("path")).select("path", F.decode("content", "UTF-8").alias("text"))


def _parsed(texts: DataFrame, parse, shape: str) -> DataFrame:
    """Records, as JSON, that ``parse`` makes of each (path, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[str] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += map(json.dumps, parse(path, text))
                except Exception as e:
                    raise CatalogError(f"{path}: {e}") from e
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["row"])

    return texts.mapInArrow(run, "row string").select(F.from_json("row", shape).alias("n")).select("n.*")


def _strings(v: Any) -> list[str] | None:
    return None if v is None else [render.as_text(x) for x in (v if isinstance(v, list) else [v])]


def parse_namespace(path: str, text: str, project: dict, environment: str | None = None, command: dict[str, str] | None = None, env: dict[str, str] | None = None, minimal: bool = False) -> list[dict]:
    """Node records of one file: rendered, parsed, with inherited variables,
    environment and tags, and dependencies qualified; ``minimal``: only the columns
    that planning needs, without working out the nodes' own variables."""
    scope = {"project": {"root": project.get("root", "")}, "cookbook": {"root": os.path.dirname(path)}, "env": env or {}, "var": dict(project.get("variables", {}))}
    variables = scope["var"] | text_variables(text, scope, environment, command)
    scope["var"] = variables
    data = parse_yaml(render.render(text, scope))
    if not isinstance(data, dict) or not data.get("name") or not isinstance(data.get("recipes"), dict):
        raise CatalogError(f"{path}: name and recipes are required")
    book, out = str(data["name"]), []
    shared = [*(project.get("environment") or []), *(data.get("environment") or [])]
    for name, r in data["recipes"].items():
        r = r or {}
        own = {} if minimal else render.process(r.get("variables") or {}, scope)
        if environment and not minimal:
            own |= render.process((r.get("overrides") or {}).get(environment) or {}, scope | {"var": variables | own})
        cache = r.get("cache")
        deps = _strings(r.get("dependencies"))
        out.append(
            {
                "fqn": f"{book}:{name}", "cookbook": book, "recipe": str(name), "description": r.get("description"),
                "tags": _strings(r.get("tags") or data.get("tags") or []),
                "dependencies": deps and [d if ":" in d else f"{book}:{d}" for d in deps],
                "environment": _strings([*shared, *(r.get("environment") or [])]),
                "config_path": path,
            }
        )
        if not minimal:
            out[-1] |= {
                "variables": {k: render.as_text(v) for k, v in (variables | own).items()},
                "run": r.get("run"), "template": r.get("template"),
                "cache": cache and {"inputs": _strings(cache.get("inputs")), "outputs": _strings(cache.get("outputs"))},
                "parameters": json.dumps(to_json_value(r["parameters"]), sort_keys=True) if r.get("parameters") is not None else None,
            }
    return out


def read_nodes(spark: SparkSession, root: str, project: dict, pattern: str = "*cookbook.y*ml", ignore: list[str] = (), ignore_files: tuple[str, ...] = (walk.GIT_IGNORE,), environment: str | None = None, command: dict[str, str] | None = None, env: dict[str, str] | None = None) -> DataFrame:
    """All node records below ``root``; any unreadable file fails the scan."""
    texts = read_texts(spark, root, pattern, ignore, ignore_files)
    return _parsed(texts, lambda path, text: parse_namespace(path, text, project, environment, command, env), NODES)


def read_minimal(spark: SparkSession, root: str, project: dict, pattern: str = "*cookbook.y*ml", ignore: list[str] = (), ignore_files: tuple[str, ...] = (walk.GIT_IGNORE,), environment: str | None = None, command: dict[str, str] | None = None, env: dict[str, str] | None = None) -> DataFrame:
    """Only what planning needs; nothing else is worked out or sent."""
    texts = read_texts(spark, root, pattern, ignore, ignore_files)
    shape = "fqn string, cookbook string, recipe string, description string, tags array<string>, dependencies array<string>, environment array<string>, config_path string"
    return _parsed(texts, lambda path, text: parse_namespace(path, text, project, environment, command, env, True), shape)


def duplicate_namespaces(nodes: DataFrame) -> DataFrame:
    """Namespaces defined by more than one file: an error, never a silent choice."""
    return nodes.groupBy("cookbook").agg(F.countDistinct("config_path").alias("files")).where("files > 1")


def read_templates(spark: SparkSession, folder: str, ignore_files: tuple[str, ...] = (walk.GIT_IGNORE,)) -> DataFrame:
    """(name, description, extends, parameters, template_path, template_content)."""
    shape = "name string, description string, extends string, parameters string, template_path string, template_content string"
    return _parsed(read_texts(spark, folder, "*.y*ml", ignore_files=ignore_files), lambda path, text: [_template(parse_yaml(text)) | {"template_path": path}], shape)


def _template(t: Any) -> dict:
    if not isinstance(t, dict) or not t.get("name") or not t.get("template"):
        raise CatalogError("a template needs name and template")
    return {"name": t["name"], "description": t.get("description"), "extends": t.get("extends"), "parameters": json.dumps(to_json_value(t.get("parameters") or {})), "template_content": t["template"]}


def read_functions(spark: SparkSession, folder: str, ignore_files: tuple[str, ...] = (walk.GIT_IGNORE,)) -> DataFrame:
    """(name, returns, parameters, run) of function files, whose name must be the
    file's."""

    def one(path: str, text: str) -> list[dict]:
        h = parse_yaml(text)
        stem = os.path.splitext(os.path.basename(path))[0]
        if not isinstance(h, dict) or h.get("name") != stem or not h.get("run"):
            raise CatalogError(f"name must be {stem!r} and run is required")
        return [{"name": stem, "returns": h.get("returns", "string"), "parameters": json.dumps(to_json_value(h.get("parameters") or {})), "run": h["run"]}]

    return _parsed(read_texts(spark, folder, "*.y*ml", ignore_files=ignore_files), one, "name string, returns string, parameters string, run string")


def valid_template_text(text: str) -> bool:
    """Not empty and parsable as it stands, before rendering."""
    try:
        return bool(text.strip()) and parse_yaml(text) is not None
    except Exception:
        return False


def instantiate(template: dict, provided: dict, functions: dict | None = None) -> dict:
    """A template's content rendered with ``params``, parsed, and its strings
    rendered again except below ``variables`` and ``run``."""
    params = {n: p["default"] for n, p in (template.get("parameters") or {}).items() if "default" in p} | provided
    for n, p in (template.get("parameters") or {}).items():
        if p.get("required") and n not in params:
            raise CatalogError(f"{template['name']}: required parameter {n!r} is missing")
        if n in params and render.kind_of(params[n]) != str(p.get("type", "string")).lower():
            raise CatalogError(f"{template['name']}: parameter {n!r} must be {p.get('type')}")
    data = parse_yaml(render.render(template["template"], {"params": params}, functions))
    return render.render_tree(data, {"params": params}, functions, skip=("variables", "run"))
