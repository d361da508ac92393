"""A small template renderer: paths, conditions, loops, comparisons, functions.

``{{a.b}}`` inserts a value (nothing if it is missing, text unescaped);
``{{#if x}}..{{else}}..{{/if}}``, ``{{#unless x}}``, ``{{#each xs}}`` with
``this``, ``@index`` and ``@key``; ``(eq a b)``, ``ne``, ``and``, ``or``, ``not``;
registered functions take positional and ``name=value`` arguments. Templates are
parsed once per worker and text; columns render in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .digests import col

_TAG = re.compile(r"\{\{\{?(~?)\s*(.*?)\s*(~?)\}?\}\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\()|(\))|"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^\s()=]+)=|([^\s()]+))""")
MAX_ARGUMENTS = 10


#: Results of a function that a worker keeps.
KEPT_RESULTS = 10_000


class TemplateError(ValueError):
    """A template that cannot be parsed or a function that cannot be called."""


class Function:
    """A user function with declared parameters (name -> dict(type, required, default)).

    Positional arguments, at most ten, bind to the parameters in alphabetical
    order; null, list and object arguments are left out of the positions; named
    ones win. The newest results are kept per argument set."""

    def __init__(self, name: str, run: Callable[..., Any], parameters: dict[str, dict] | None = None, returns: str = "string"):
        if returns not in ("string", "array"):
            raise TemplateError(f"{name}: returns must be string or array")
        self.name, self.run, self.parameters, self.returns = name, run, parameters or {}, returns
        self.kept: dict[str, Any] = {}

    def __call__(self, args: list[Any], named: dict[str, Any]) -> Any:
        plain = [a for a in args if not (a is None or isinstance(a, (list, dict)))][:MAX_ARGUMENTS]
        given = dict(zip(sorted(self.parameters), plain)) | named
        values = {n: p["default"] for n, p in self.parameters.items() if "default" in p} | given
        for n, p in self.parameters.items():
            if p.get("required") and n not in values:
                raise TemplateError(f"{self.name}: required parameter {n!r} is missing")
            if n in values and p.get("type") and kind_of(values[n]) != p["type"]:
                raise TemplateError(f"{self.name}: parameter {n!r} must be {p['type']}")
        values = {n: int(v) if isinstance(v, float) else v for n, v in values.items()}
        key = json.dumps(values, sort_keys=True, default=str)
        if key not in self.kept:
            out = self.run(**values)
            if len(self.kept) >= KEPT_RESULTS:
                self.kept.pop(next(iter(self.kept)))
            self.kept[key] = lines(out) if self.returns == "array" and isinstance(out, str) else out
        return self.kept[key]


def lines(text: str) -> list[str]:
    """Trimmed lines without blank ones."""
    return [x.strip() for x in text.splitlines() if x.strip()]


def kind_of(v: Any) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "null"


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text!r}")
        for kind, value in zip(("(", ")", "text", "text", "name", "word"), m.groups()):
            if value is not None:
                out.append((kind, re.sub(r"\\(.)", r"\1", value) if kind == "text" else value))
                break
        at = m.end()
    return out


def _expression(tokens: list[tuple[str, str]]) -> tuple:
    """('call', head, positional, named) or ('value', ...) of all tokens."""

    def atom() -> tuple:
        kind, value = tokens.pop(0)
        if kind == "(":
            inner = call()
            if not tokens or tokens.pop(0)[0] != ")":
                raise TemplateError("missing )")
            return inner
        if kind == "text":
            return ("constant", value)
        if kind != "word":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false"):
            return ("constant", value == "true")
        if value in ("null", "undefined"):
            return ("constant", None)
        if re.fullmatch(r"-?\d+", value):
            return ("constant", int(value))
        if re.fullmatch(r"-?\d*\.\d+", value):
            return ("constant", float(value))
        return ("path", value)

    def call() -> tuple:
        head = atom()
        args, named = [], {}
        while tokens and tokens[0][0] != ")":
            if tokens[0][0] == "name":
                name = tokens.pop(0)[1]
                named[name] = atom()
            else:
                args.append(atom())
        return ("call", head, args, named)

    out = call()
    if tokens:
        raise TemplateError("unexpected )")
    return out


@lru_cache(maxsize=4096)
def parse(text: str) -> tuple:
    """A tree of ('text', s), ('out', e), (block, e, body, otherwise)."""
    root: list = []
    stack: list[list] = [[None, None, root, None]]
    at = 0
    for m in _TAG.finditer(text):
        plain = text[at : m.start()]
        at = m.end()
        if m.group(1):
            plain = plain.rstrip()
        if m.group(3):
            at += len(text[at:]) - len(text[at:].lstrip())
        body = stack[-1][3] if stack[-1][3] is not None else stack[-1][2]
        if plain:
            body.append(("text", plain))
        tag = m.group(2)
        if tag.startswith("!"):
            continue
        if tag.startswith("#"):
            name, _, rest = tag[1:].strip().partition(" ")
            if name not in ("if", "unless", "each", "with"):
                raise TemplateError(f"unknown block {name!r}")
            stack.append([name, _expression(_tokens(rest)), [], None])
        elif tag == "else" or tag == "^":
            if len(stack) < 2:
                raise TemplateError("else outside a block")
            stack[-1][3] = []
        elif tag.startswith("/"):
            if len(stack) < 2 or stack[-1][0] != tag[1:].strip():
                raise TemplateError(f"unexpected end {tag!r}")
            name, e, inner, other = stack.pop()
            (stack[-1][3] if stack[-1][3] is not None else stack[-1][2]).append((name, e, tuple(inner), tuple(other or ())))
        else:
            body.append(("out", _expression(_tokens(tag))))
    if len(stack) > 1:
        raise TemplateError(f"block {stack[-1][0]!r} is not closed")
    if text[at:]:
        root.append(("text", text[at:]))
    return tuple(root)


def truthy(v: Any) -> bool:
    return bool(v) and v != 0


def as_text(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return json.dumps(v) if isinstance(v, (list, dict)) else str(v)


class _Scope:
    def __init__(self, values: Any, functions: dict[str, Function], parent: _Scope | None = None, extra: dict | None = None):
        self.values, self.functions, self.parent, self.extra = values, functions, parent, extra or {}

    def look(self, path: str) -> Any:
        if path.startswith("../") and self.parent:
            return self.parent.look(path[3:])
        if path in self.extra:
            return self.extra[path]
        if path == "this" or path == ".":
            return self.values
        parts = re.split(r"[./]", path.removeprefix("this."))
        v = self.values
        for p in parts:
            p = p.strip("[]")
            if isinstance(v, dict) and p in v:
                v = v[p]
            elif isinstance(v, list) and p.isdigit() and int(p) < len(v):
                v = v[int(p)]
            else:
                return self.parent.look(path) if self.parent else None
        return v

    def value(self, e: tuple) -> Any:
        if e[0] == "constant":
            return e[1]
        if e[0] == "path":
            return self.look(e[1])
        _, head, args, named = e
        if head[0] == "path":
            f = head[1]
            if f in self.functions:
                return self.functions[f]([self.value(a) for a in args], {k: self.value(a) for k, a in named.items()})
            if args:
                xs = [self.value(a) for a in args]
                if f == "eq":
                    return xs[0] == xs[1]
                if f == "ne":
                    return xs[0] != xs[1]
                if f == "and":
                    return all(map(truthy, xs))
                if f == "or":
                    return any(map(truthy, xs))
                if f == "not":
                    return not truthy(xs[0])
                raise TemplateError(f"unknown function {f!r}")
        return self.value(head)

    def render(self, tree: tuple) -> str:
        out = []
        for node in tree:
            if node[0] == "text":
                out.append(node[1])
            elif node[0] == "out":
                out.append(as_text(self.value(node[1])))
            else:
                kind, e, body, other = node
                v = self.value(e)
                if kind in ("if", "unless"):
                    out.append(self.render(body if truthy(v) == (kind == "if") else other))
                elif kind == "with":
                    out.append(_Scope(v, self.functions, self).render(body) if truthy(v) else self.render(other))
                elif not v:
                    out.append(self.render(other))
                else:
                    items = list(v.items()) if isinstance(v, dict) else list(enumerate(v))
                    for i, (k, x) in enumerate(items):
                        extra = {"@index": i, "@key": k, "@first": i == 0, "@last": i == len(items) - 1}
                        out.append(_Scope(x, self.functions, self, extra).render(body))
        return "".join(out)


def render(text: str, values: dict, functions: dict[str, Function] | None = None) -> str:
    return _Scope(values, functions or {}).render(parse(text))


def render_tree(value: Any, values: dict, functions: dict[str, Function] | None = None, skip: tuple[str, ...] = ()) -> Any:
    """Every string of a nested value rendered; a string that was a template is
    read again as a scalar. Keys in ``skip`` are left as they are."""
    if isinstance(value, dict):
        return {k: v if k in skip else render_tree(v, values, functions, skip) for k, v in value.items()}
    if isinstance(value, list):
        return [render_tree(v, values, functions, skip) for v in value]
    if isinstance(value, str) and "{{" in value and "}}" in value:
        return retyped(render(value, values, functions))
    return value


def retyped(text: str) -> Any:
    """A text as the scalar it spells (null, true, false, number), else itself."""
    t = text.strip()
    if t in ("null", "~", ""):
        return None if t else text
    if t in ("true", "false"):
        return t == "true"
    if re.fullmatch(r"[-+]?\d+", t):
        return int(t)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", t):
        return float(t)
    return text


def process(variables: dict[str, Any], scope: dict, command: dict[str, str] | None = None, functions: dict[str, Function] | None = None) -> dict[str, Any]:
    """Variables rendered left to right, each seeing those before it under ``var``;
    command-line values, read as scalars, replace declared ones."""
    command = command or {}
    done = dict(scope.get("var", {}))
    out = {}
    for k, v in variables.items():
        v = retyped(command[k]) if k in command else render_tree(v, scope | {"var": done}, functions)
        out[k] = done[k] = v
    return out


def render_column(template: Column | str, context: Column | str, functions: dict[str, Function] | None = None) -> Column:
    """Renders a column of templates with a column of JSON objects; null templates
    give null, a null context is empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else render(t, json.loads(c) if c else {}, functions) for t, c in zip(texts, contexts)])

    return run(col(template), col(context))


def register(spark, function: Function) -> None:
    """Makes a user function callable from SQL with positional arguments."""
    kind = "string" if function.returns == "string" else "array<string>"
    spark.udf.register(function.name, lambda *args: function(list(args), {}), kind)
