"""Distributed listing and reading of file trees, ignore files included.

Spark's own listings leave out every name that begins with ``_`` or ``.``; these
do not. Folders are walked in Arrow tasks: a task lists a folder and what lies
below it until it has met ``STEP_ENTRIES`` entries, and hands the folders it has
not opened to the next round, where they are spread again. So neither a wide nor a
deep tree falls to one task or to the driver, which only counts open folders.

Local paths (shared mounts on a cluster) are walked by ``os.scandir``; paths with
a scheme by ``pyarrow.fs``. Links to folders are not followed, linked files are
not listed. Ignore files follow the usual rules: the nearest file and the last
matching line decide, ``!`` takes back, a slash before the end ties a line to its
folder, one at the end means folders; nothing below an ignored folder comes back.
Those of the folders above the root count too, up to the top of the checkout.

Defined results: a missing root lists nothing; files that cannot be read fail the
scan; empty files have size 0.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import glob_regex
from ..session import cut

STEP_ENTRIES = 20_000
#: Bytes of contents in one Arrow batch.
BATCH_BYTES = 32 << 20
GIT_IGNORE = ".gitignore"

Rule = tuple[str, str]  # the folder that holds the ignore file, the line


def _remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def _local(path: str) -> str:
    return re.sub("^file:(//)?", "", path)


def absolute(path: str) -> str:
    """As listings name it."""
    return path.rstrip("/") if _remote(path) else os.path.abspath(_local(path))


def _entries(folder: str) -> Iterator[tuple[str, str, int]]:
    """(name, kind, size) of a folder's entries; kind ``d`` or ``f``."""
    if _remote(folder):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if x.type in (fs.FileType.Directory, fs.FileType.File):
                yield x.base_name, "d" if x.type == fs.FileType.Directory else "f", x.size or 0
        return
    with os.scandir(folder) as found:
        for x in found:
            if x.is_dir(follow_symlinks=False):
                yield x.name, "d", 0
            elif x.is_file(follow_symlinks=False):
                yield x.name, "f", x.stat().st_size


def read_bytes(path: str) -> bytes:
    if _remote(path):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_stream(inner) as f:
            return f.read()
    with open(_local(path), "rb") as f:
        return f.read()


def read_range(path: str, offset: int, length: int) -> bytes:
    """``length`` bytes from ``offset`` on; nothing else of the file is read."""
    if _remote(path):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_file(inner) as f:
            return f.read_at(length, offset)
    with open(_local(path), "rb") as f:
        f.seek(offset)
        return f.read(length)


def write_bytes(path: str, data: bytes) -> None:
    """Written beside the target and moved, so that readers never see half a file and a
    repeated task gives the same one."""
    if _remote(path):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_output_stream(inner) as f:
            f.write(data)
        return
    path = _local(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


_COMPILED: dict[str, tuple[re.Pattern, bool, bool, bool] | None] = {}


def _compiled(line: str) -> tuple[re.Pattern, bool, bool, bool] | None:
    """(pattern, tied to the folder, folders only, takes back) of an ignore line."""
    if line not in _COMPILED:
        rule = line.rstrip("\r\n")
        rule = rule if rule.endswith("\\ ") else rule.rstrip()
        back = rule.startswith("!")
        rule = rule[1:] if back else rule
        if not rule.strip("/") or (rule.startswith("#") and not back):
            out = None
        else:
            only = rule.endswith("/")
            rule = rule.rstrip("/")
            tied = "/" in rule
            rule = rule.lstrip("/")
            rule = rule[1:] if rule.startswith(("\\#", "\\!")) else rule
            out = (re.compile(glob_regex(rule)), tied, only, back)
        if len(_COMPILED) > 10_000:
            _COMPILED.clear()
        _COMPILED[line] = out
    return _COMPILED[line]


def left_out(path: str, folder: bool, rules: list[Rule]) -> bool:
    """Whether the rules, from the outermost file to the nearest, leave ``path`` out."""
    name = path.rsplit("/", 1)[-1]
    for base, line in reversed(rules):
        made = _compiled(line)
        if made is None or not path.startswith(base.rstrip("/") + "/"):
            continue
        pattern, tied, only, back = made
        if only and not folder:
            continue
        if pattern.match(path[len(base.rstrip("/")) + 1 :] if tied else name):
            return not back
    return False


def _lines(path: str, base: str) -> list[Rule]:
    return [(base, x) for x in read_bytes(path).decode("utf-8", "replace").splitlines() if x.strip()]


def rules_above(root: str, names: tuple[str, ...]) -> tuple[list[Rule], bool]:
    """Rules of the folders above the root, outermost first, and whether the root lies
    in a checkout (a folder above it, or itself, holds ``.git``)."""
    if _remote(root):
        return [], True
    ups, at = [], os.path.abspath(root)
    while not os.path.exists(os.path.join(at, ".git")):
        up = os.path.dirname(at)
        if up == at:
            ups = []
            break
        at = up
        ups.append(at)
    else:
        return [r for up in reversed(ups) for n in names if os.path.isfile(os.path.join(up, n)) for r in _lines(os.path.join(up, n), up)], True
    return [], False


def _walk(start: str, rules: list[Rule], names: tuple[str, ...], hidden: bool, budget: int) -> Iterator[tuple[str, str, int, str]]:
    """(kind, path, size, rules): files, and folders left for another round."""
    todo = [(start, rules)]
    while todo:
        folder, rules = todo.pop()
        if budget <= 0:
            yield "d", folder, 0, json.dumps(rules)
            continue
        found = sorted(_entries(folder))
        files = {n for n, kind, _ in found if kind == "f"}
        rules = rules + [r for n in names if n in files for r in _lines(f"{folder}/{n}", folder)]
        for name, kind, size in found:
            budget -= 1
            path = f"{folder}/{name}"
            if (not hidden and name.startswith(".")) or (rules and left_out(path, kind == "d", rules)):
                continue
            if kind == "d":
                todo.append((path, rules))
            else:
                yield "f", path, size, ""


def _round(names: tuple[str, ...], hidden: bool, step: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, rules in zip(batch.column("path").to_pylist(), batch.column("rules").to_pylist()):
                rows = list(_walk(folder, [tuple(r) for r in json.loads(rules)], names, hidden, step))
                for a in range(0, len(rows), 10_000):
                    kind, path, size, left = zip(*rows[a : a + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(path), pa.array(size, pa.int64()), pa.array(left)], names=["kind", "path", "size", "rules"])

    return run


def list_files(spark: SparkSession, root: str, hidden: bool = True, ignore_files: tuple[str, ...] = (GIT_IGNORE,), ignore: list[str] = (), step: int = STEP_ENTRIES) -> DataFrame:
    """(path, size) of every file below ``root``.

    ``hidden``: also names that begin with a dot. ``ignore_files``: names of files in
    the tree whose lines leave files out; ``.gitignore`` only counts inside a checkout.
    ``ignore``: more lines, tied to the root.
    """
    root = absolute(root).rstrip("/") or "/"
    empty = spark.createDataFrame([], "path string, size bigint")
    if not _remote(root) and not os.path.isdir(root):
        return empty
    rules, checkout = rules_above(root, tuple(ignore_files))
    names = tuple(n for n in ignore_files if checkout or n != GIT_IGNORE)
    rules = [r for r in rules if r[1]] + [(root, line) for line in ignore]
    spread = spark.sparkContext.defaultParallelism
    open_ = spark.createDataFrame([(root, json.dumps(rules))], "path string, rules string")
    out = None
    while True:
        seen = cut(open_.mapInArrow(_round(names, hidden, step), "kind string, path string, size bigint, rules string"))
        files = seen.where("kind = 'f'").select("path", "size")
        out = files if out is None else out.unionByName(files)
        open_ = seen.where("kind = 'd'").select("path", "rules")
        left = open_.count()
        if not left:
            return out
        open_ = open_.repartition(min(left, 4 * spread))


def with_contents(files: DataFrame, path: str = "path", into: str = "content") -> DataFrame:
    """``files`` with the bytes of each; read in batches of bounded size."""
    columns = files.columns
    shape = files.withColumn(into, F.lit(None).cast("binary")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, held, size, begin = batch.column(path).to_pylist(), [], 0, 0
            for n, p in enumerate(paths):
                held.append(read_bytes(p))
                size += len(held[-1])
                if size >= BATCH_BYTES or n + 1 == len(paths):
                    part = batch.slice(begin, n + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(held, pa.binary())], names=[*columns, into])
                    held, size, begin = [], 0, n + 1

    return files.mapInArrow(run, shape)


def write_files(df: DataFrame, path: str = "path", content: str = "content") -> int:
    """Writes one file per row, in parallel; the number of files written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                write_bytes(p, data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    done = df.select(F.col(path), F.col(content).cast("binary")).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0]
    return done or 0
