import os

import pytest
from conftest import rows

from pyspark.sql import functions as F

from stowage.functions import blake3
from stowage.operators import graph, store
from stowage.sources import catalog, files, walk
from stowage.streaming import index as stream

PROJECT = """name: demo
environment: [CI]
variables:
  stage: base
  url: "http://{{var.stage}}"
overrides:
  dev:
    stage: dev
config:
  {{#if (eq env.FAST "1")}}
  jobs: 8
  {{/if}}
  bucket: b-{{var.stage}}
"""
FOO = """name: foo
environment: [FOO]
tags: [shared]
variables:
  dir: "{{var.stage}}/data"
recipes:
  build:
    run: make {{ var.dir }} {{ project.root }}
    dependencies: [prepare, bar:lib]
    cache: {inputs: ["src/**/*.c"], outputs: [out]}
    tags: [own]
  prepare:
    run: |
      echo {{ env.NAME }}
    variables: {k: 1, t: yes}
"""
BAR = """name: bar
recipes:
  lib:
    template: lib-template
    parameters: {jobs: 3}
"""


@pytest.fixture
def tree(tmp_path):
    for path, text in {"main.yml": PROJECT, "foo/cookbook.yml": FOO, "deep/er/bar.cookbook.yaml": BAR, "skip/cookbook.yml": "broken: [", "foo/src/a/x.c": "int x;", "foo/src/.h.c": "h", "foo/out/f": "1", "foo/out/g/h": "22"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_locate_and_project(tree):
    names = ("main.yml", "main.yaml")
    assert catalog.locate(str(tree / "deep" / "er"), names) == str(tree / "main.yml")
    (tree / "deep" / ".git").mkdir()
    with pytest.raises(catalog.CatalogError):
        catalog.locate(str(tree / "deep" / "er"), names)
    p = catalog.read_project(str(tree), names, "dev", env={"FAST": "1"})
    assert p["config"] == {"jobs": 8, "bucket": "b-dev"} and p["variables"] == {"stage": "dev", "url": "http://base"}
    assert catalog.read_project(str(tree), names, None, {"stage": "cli"})["config"] == {"bucket": "b-cli"}
    with pytest.raises(catalog.CatalogError):
        catalog.read_project(str(tree / "none.yml"), names)


def test_nodes(spark, tree):
    project = {"root": "/r", "environment": ["CI"], "variables": {"stage": "s"}}
    nodes = catalog.read_nodes(spark, str(tree), project, ignore=["skip/"], env={"NAME": "me"})
    by = {r.fqn: r for r in nodes.collect()}
    assert sorted(by) == ["bar:lib", "foo:build", "foo:prepare"]
    b = by["foo:build"]
    assert b.run == "make s/data /r" and b.dependencies == ["foo:prepare", "bar:lib"] and b.tags == ["own"] and b.environment == ["CI", "FOO"]
    assert b.cache.inputs == ["src/**/*.c"] and by["foo:prepare"].tags == ["shared"]
    assert by["foo:prepare"].variables == {"stage": "s", "dir": "s/data", "k": "1", "t": "yes"} and by["bar:lib"].parameters == '{"jobs": 3}'
    assert by["foo:prepare"].run == "echo me\n"
    assert rows(graph.levels(nodes, graph.edges(nodes))) == [(0, "bar:lib"), (0, "foo:prepare"), (1, "foo:build")]
    assert catalog.duplicate_namespaces(nodes).count() == 0
    assert "run" not in catalog.read_minimal(spark, str(tree), project, ignore=["skip/"]).columns
    with pytest.raises(Exception, match="skip"):
        catalog.read_nodes(spark, str(tree), project).collect()
    assert catalog.read_nodes(spark, str(tree / "nowhere"), project).count() == 0


def test_yaml_core_schema():
    assert catalog.parse_yaml("a: yes\nb: 010\nc: ~\nd: 0x1f\ne: 2020-01-01\nf: !t [1]\ng: .inf") == {"a": "yes", "b": 10, "c": None, "d": 31, "e": "2020-01-01", "f": [1], "g": float("inf")}
    assert catalog.to_json_value({"x": float("nan"), 3: 1, "y": [float("inf")]}) == {"x": 0, "y": [0]}


@pytest.mark.parametrize("path, rules, want", [("a/b.o", ["*.o"], True), ("a/b.o", ["*.o", "!b.o"], False), ("target/x", ["target/"], True), ("target", ["target/"], False), ("a/t/x", ["/t"], False), ("t/x", ["/t/"], True), ("x", ["# x", ""], False)])
def test_ignore_rules(path, rules, want):
    assert catalog.ignored(path, rules) == want


def test_templates_and_functions(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "lib.yml").write_text("name: lib\ndescription: d\nextends: base\nparameters: {jobs: {type: number, default: 2}}\ntemplate: |\n  run: go {{ params.jobs }}\n  tags: ['{{ params.jobs }}']\n")
    t = catalog.read_templates(spark, str(tmp_path / "t")).first()
    assert (t.name, t.extends, t.parameters) == ("lib", "base", '{"jobs": {"type": "number", "default": 2}}')
    spec = {"name": "lib", "template": t.template_content, "parameters": {"jobs": {"type": "number", "default": 2}, "s": {"type": "string", "required": True}}}
    assert catalog.instantiate(spec, {"s": "x", "jobs": 5}) == {"run": "go 5", "tags": ["5"]}
    for bad in ({}, {"s": 1}, {"s": "x", "jobs": "many"}):
        with pytest.raises(catalog.CatalogError):
            catalog.instantiate(spec, bad)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "up.yml").write_text("name: up\nrun: echo\nreturns: array\n")
    assert catalog.read_functions(spark, str(tmp_path / "f")).first().returns == "array"
    (tmp_path / "f" / "other.yml").write_text("name: up\nrun: echo\n")
    with pytest.raises(Exception, match="other"):
        catalog.read_functions(spark, str(tmp_path / "f")).collect()
    assert catalog.read_templates(spark, str(tmp_path / "none")).count() == 0
    assert catalog.valid_template_text("a: 1") and not catalog.valid_template_text("  ") and not catalog.valid_template_text("a: [")


def test_file_scans(spark, tree):
    root = str(tree / "foo")
    assert rows(files.hashed_files(spark, root, ["src/**/*.c"]), "path") == [("src/.h.c",), ("src/a/x.c",)]
    outputs = spark.createDataFrame([("out",), ("cookbook.yml",), ("absent",)], "path string")
    assert rows(files.expand_outputs(files.read_files(spark, root), outputs), "path") == [("cookbook.yml",), ("out/f",), ("out/g/h",)]


NAMES = ("pkg/__init__.py", "pkg/a.py", "_gen/x.py", ".env.py", "_", ".git/HEAD.py", "deep/er/_x/.y/z.py")


def test_no_name_is_left_out(spark, tmp_path):
    for n in NAMES:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    os.symlink(tmp_path / "pkg", tmp_path / "loop")
    for step in (1, 3, 10**6):
        got = walk.list_files(spark, str(tmp_path), step=step)
        assert rows(got) == sorted(((str(tmp_path / n), len(n)) for n in NAMES), key=repr)
    got = files.hashed_files(spark, str(tmp_path), ["**/*.py"], ignore_files=())
    assert rows(got) == sorted(((n, len(n), blake3.digest(n.encode())) for n in NAMES if n.endswith(".py")), key=repr)
    assert rows(files.read_files(spark, str(tmp_path / "none"))) == []
    outputs = spark.createDataFrame([("_gen",), ("pkg",), (".env.py",)], "path string")
    assert rows(files.expand_outputs(files.read_files(spark, str(tmp_path), contents=False), outputs), "path") == [(".env.py",), ("_gen/x.py",), ("pkg/__init__.py",), ("pkg/a.py",)]


def test_ignore_files_of_the_tree_decide(spark, tmp_path):
    texts = {
        ".gitignore": "*.log\n/build/\n!keep.log\n", "a.log": "", "keep.log": "", "build/x": "", "sub/build/x": "", "sub/.gitignore": "!a.log\nonly/*.c\n", "sub/a.log": "",
        "sub/only/a.c": "", "sub/only/d/a.c": "", "sub/.own": "d/\n", "x.c": "",
    }
    for n, t in texts.items():
        (tmp_path / "top" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "top" / n).write_text(t)
    root = str(tmp_path / "top")
    names = lambda **o: {r.path[len(root) + 1 :] for r in walk.list_files(spark, root, **o).collect()}
    assert names() == set(texts)  # no checkout: .gitignore does not count
    assert names(ignore_files=(".own",)) == set(texts) - {"sub/only/d/a.c"}
    (tmp_path / "top" / ".git").mkdir()
    assert names() == set(texts) - {"a.log", "build/x", "sub/only/a.c"}
    assert names(hidden=False, ignore=["*.c"]) == {"keep.log", "sub/build/x", "sub/a.log"}
    inner = {r.path[len(root) + 1 :] for r in walk.list_files(spark, root + "/sub").collect()}
    assert inner == {"sub/build/x", "sub/.gitignore", "sub/a.log", "sub/only/d/a.c", "sub/.own"}


def test_manifest_and_log_files(spark, tmp_path):
    m = spark.createDataFrame([("k_1", "a:b", 0, [("p", "d", 1, True, None)], None, None, None), (None, "x", 1, None, None, None, None)], files.MANIFEST)
    root = str(tmp_path / "m")
    assert files.write_manifest_files(m, root) == 1 and os.listdir(root) == ["6b5f31.json"]
    assert files.write_manifest_files(m.withColumn("recipe", F.lit("a:c")), root) == 1
    (tmp_path / "m" / "xyz.json").write_text("{}")
    back = files.read_manifest_files(spark, root).collect()
    assert [(r.action_key, r.recipe, r.outputs[0].path) for r in back] == [("k_1", "a:c", "p")]
    logs = spark.createDataFrame([("a:b", "out", "err"), ("_c:d", None, "e")], "fqn string, stdout string, stderr string")
    assert files.write_log_files(logs, str(tmp_path / "l")) == 2
    assert (tmp_path / "l" / "a.b.log").read_text() == "outerr" and (tmp_path / "l" / "_c.d.log").read_text() == "e"


def test_blob_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    blobs = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),), (None,)], "content binary")
    files.put_blobs(blobs, path)
    files.put_blobs(blobs.limit(2), path)
    stored = files.read_blobs(spark, path)
    assert sorted(bytes(r.content) for r in stored.collect()) == [b"one", b"two"]
    assert files.read_blobs(spark, str(tmp_path / "none")).count() == 0
    h = "ab" * 32
    (tmp_path / "cas" / "sha256" / "ab").mkdir(parents=True)
    (tmp_path / "cas" / "sha256" / "ab" / h).write_text("x")
    (tmp_path / "cas" / "sha256" / "ab" / "bad").write_text("x")
    assert rows(files.list_blobs(spark, str(tmp_path / "cas"))) == [("sha256", h)]
    outputs = spark.createDataFrame([("p", stored.first().digest, 3, True), ("q", "zz", 1, None)], "path string, digest string, size long, is_executable boolean")
    assert rows(files.restore_plan(outputs, stored), "path", "mode", "available") == [("p", "755", True), ("q", "644", False)]


def test_manifests_and_logs(spark, tmp_path):
    m = spark.createDataFrame([("k1", "a:b", 0, [("p", "d", 1, True, None)], None, None, None)], files.MANIFEST)
    files.write_manifests(m, str(tmp_path / "m"))
    back = files.read_manifests(spark, str(tmp_path / "m")).first()
    assert back.action_key == "k1" and back.outputs[0].path == "p"
    assert '"recipe":"a:b"' in m.select(files.manifest_json()).first()[0]
    files.write_logs(spark.createDataFrame([("a:b", "out", "err")], "fqn string, stdout string, stderr string"), str(tmp_path / "l"))
    assert os.path.isdir(tmp_path / "l" / "log=a.b.log")
    os.environ["X_SET"] = "1"
    assert files.environment_values(["X_SET", "X_UNSET"]) == {"X_SET": "1", "X_UNSET": ""}
    n = spark.createDataFrame([("a:b", (["i"], ["o1", "o2"]))], "fqn string, cache struct<inputs:array<string>,outputs:array<string>>")
    assert rows(files.clean_list(n.select("fqn"), n)) == [("a:b", "o1"), ("a:b", "o2")]
    assert files.dump(n).count() == 1 and files.to_text({"b": 1, "a": 2}) == '{"a": 2, "b": 1}'


def test_streamed_index(spark, tmp_path):
    shape = "kind string, digest string, algorithm string, size long, at long"
    source = str(tmp_path / "in")
    steps = [[("put", "a", "sha256", 5, 10), ("put", "b", "sha256", 6, 11)], [("access", "a", None, None, 20), ("access", "a", None, None, 21), ("put", "b", "sha256", 7, 30)]]
    for rows_ in steps:
        spark.createDataFrame(rows_, shape).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(shape).parquet(source)
        stream.maintain(events, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()
    last = stream.read_version(spark, str(tmp_path / "index"), 1)
    assert rows(last, "digest", "size", "access_count", "last_accessed") == [("a", 5, 3, 21), ("b", 7, 1, 30)]
    assert store.index_stats(last).first().bytes == 12
