import hashlib
import hmac
import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage.functions import chunking, codec, digests, render, signing, versions
from stowage.operators import overlay, selection, store

# -- selection --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def some(spark):
    data = [("foo", "build", ["Fast"]), ("foo", "build-dep", []), ("bar", "build", ["slow", "ci"]), ("bar", "test", None), ("foobar", "test", ["ci"])]
    return spark.createDataFrame(data, "cookbook string, recipe string, tags array<string>")


def names(df):
    return sorted(f"{r.cookbook}:{r.recipe}" for r in df.collect())


@pytest.mark.parametrize(
    "pattern, want",
    [("foo:build", ["foo:build"]), (":build", ["bar:build", "foo:build"]), ("bar:", ["bar:build", "bar:test"]), ("no:pe", []), (":", ["bar:build", "bar:test", "foo:build", "foo:build-dep", "foobar:test"])],
)
def test_exact(some, pattern, want):
    assert names(selection.select_exact(some, pattern)) == want


@pytest.mark.parametrize("pattern, want", [("foo:buil", ["foo:build", "foo:build-dep"]), ("^foo$:^build$", ["foo:build"]), (":^t", ["bar:test", "foobar:test"]), ("oba:", ["foobar:test"])])
def test_regex(some, pattern, want):
    assert names(selection.select_regex(some, pattern)) == want


def test_selection_errors_and_tags(some):
    with pytest.raises(ValueError):
        selection.select_exact(some, "nocolon")
    for bad in ("a:(?=b)", "a:(b)\\1", "a:(?<!x)y"):
        with pytest.raises(ValueError):
            selection.select_regex(some, bad)
    assert names(selection.select_tags(some, ["FAST", "slow"])) == ["bar:build", "foo:build"]
    assert names(selection.select_tags(some, [])) == names(some)
    assert names(selection.select(some, ":build", tags=["ci"])) == ["bar:build"]


@pytest.mark.parametrize(
    "glob, path, want",
    [
        ("*.txt", "a.txt", True), ("*.txt", "d/a.txt", False), ("**/*.txt", "a.txt", True), ("**/*.txt", "d/e/a.txt", True), ("d/**", "d/e/f", True),
        ("d/*/f", "d/e/f", True), ("d/*/f", "d/e/g/f", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("a[bc]", "ac", True), ("a[!bc]", "ac", False),
        ("{a,b}/x", "b/x", True), ("a.b", "aXb", False), ("a+(b)", "a+(b)", True), ("src/**/*", "src/a/b", True), ("src/**/*", "src/a", True),
    ],
)
def test_globs(glob, path, want):
    import re

    assert bool(re.search(selection.glob_regex(glob), path)) == want


def test_small_predicates(spark):
    assert selection.normal_pattern(' "../x/*.y" ', "/a/b") == "/a/x/*.y"
    assert selection.normal_pattern("./q/../z", "/a") == "/a/z"
    assert selection.parse_key_values(["a=b=c", "d="]) == {"a": "b=c", "d": ""}
    with pytest.raises(ValueError):
        selection.parse_key_values(["x"])
    df = spark.createDataFrame([("a=b=c", " \n", "{{x}}", 10), ("q", "go", "x", None)], "kv string, run string, t string, at long")
    assert [r[0] for r in df.select(selection.key_value("kv")).collect()] == [("a", "b=c"), None]
    assert selection.blank_run(df).count() == 1
    assert [r[0] for r in df.select(selection.has_template("t")).collect()] == [True, False]
    assert [r[0] for r in df.select(selection.due("at", F.lit(10 + 86_400 * 2), 2)).collect()] == [True, True]
    assert [r[0] for r in df.select(selection.due("at", F.lit(9 + 86_400 * 2), 2)).collect()] == [False, True]
    v = spark.createDataFrame([("1.10.0", "1.9.9"), ("1.2", "1.2.0"), ("2.x.1", "2.1"), ("1.0-rc1", "1.0")], "a string, b string")
    assert [r[0] for r in v.select(versions.newer("a", "b")).collect()] == [True, False, False, False]
    assert [r[0] for r in v.select(versions.prerelease("a")).collect()] == [False, False, False, True]
    assert v.select(versions.without_v(F.lit("v1.2"))).first()[0] == "1.2"


# -- store ------------------------------------------------------------------------------


def index_of(spark, data):
    return spark.createDataFrame(data, store.INDEX_SCHEMA)


def test_index_life(spark):
    index = index_of(spark, [("a", "sha256", 10, 1, 5, 9, 0), ("b", "sha256", 20, 2, 1, 2, 0)])
    puts = store.new_rows(spark.createDataFrame([("a", "sha256", 11, 50), ("c", "sha256", 5, 51)], "digest string, algorithm string, size long, at long"))
    after = store.upsert(index, puts)
    assert rows(after) == [("a", "sha256", 11, 50, 1, 50, 0), ("b", "sha256", 20, 2, 1, 2, 0), ("c", "sha256", 5, 51, 1, 51, 0)]
    access = spark.createDataFrame([("b", 60), ("b", 40), ("zz", 1)], "digest string, at long")
    assert ("b", "sha256", 20, 2, 3, 60, 0) in rows(store.touch(after, access))
    assert rows(store.delete(after, access), "digest") == [("a",), ("c",)]
    assert store.add_column(index, "note", "string").columns[-1] == "note" and store.add_column(index, "size", "int") is index
    assert rows(store.index_stats(index)) == [(2, 30, 15.0)] and rows(store.index_stats(index.limit(0))) == [(0, 0, 0.0)]


def test_dedup_figures(spark):
    refs = spark.createDataFrame([("a", 10), ("a", 10), ("a", 10), ("b", 7)], "digest string, size long")
    stats = store.dedup_ratio(store.storage_stats(refs))
    assert rows(stats) == [(2, 17, 1, 3, 4, 0.5, 16)]
    assert rows(store.dedup_ratio(store.storage_stats(refs.limit(0)))) == [(0, 0, 0, 0, 0, 0.0, 0)]
    assert rows(store.link_savings(refs)) == [(20,)]


def test_tiers(spark):
    tiers = spark.createDataFrame([(0, "a", None), (1, "a", 5), (1, "b", 6), (2, "b", 7), (2, "c", 8)], "tier int, digest string, size long")
    want = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "digest string")
    found = store.first_tier(want, tiers)
    assert rows(found) == [("a", 0), ("b", 1), ("c", 2), ("d", None)]
    assert rows(store.promotions(found)) == [("b", 0), ("c", 0), ("c", 1)]
    assert rows(store.size_lookup(want, tiers)) == [("a", 5), ("b", 6), ("c", 8), ("d", None)]
    batches = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "c"), ("z", "c")], "batch string, digest string")
    assert rows(store.batch_get(batches, tiers)) == [("x", 1), ("y", None), ("z", 2)]
    assert rows(store.contains_many(want, tiers)) == [("a", True), ("b", True), ("c", True), ("d", False)]
    assert rows(store.listing(want, tiers)) == [("a",), ("b",), ("c",), ("d",)]
    assert store.put_all(want, [0, 1]).count() == 8
    results = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "digest string, ok boolean")
    assert rows(store.any_success(results)) == [("a", True), ("b", False)]


def test_cache_results(spark):
    outputs = spark.createDataFrame([("k1", "p1", "a", 1), ("k1", "p2", "b", 2), ("k2", "p3", "c", 3), ("k3", "p4", "zz", 4)], "action_key string, path string, digest string, size long")
    have = spark.createDataFrame([("a",), ("b",)], "digest string")
    files = spark.createDataFrame([("p4", 4), ("p3", 99)], "path string, size long")
    actions = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",)], "action_key string")
    assert rows(store.cache_results(actions, outputs, have, files)) == [("k1", "hit"), ("k2", "miss"), ("k3", "hit"), ("k4", "miss")]
    assert rows(selection.needs_restore(outputs, files), "path") == [("p1",), ("p2",), ("p3",)]
    assert rows(store.to_upload(outputs, have), "digest") == [("c",), ("zz",)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 100)), st.integers(0, 300_000)), max_size=30), st.integers(0, 900))
def test_evict_to_size_is_least(spark, blobs, target):
    index = index_of(spark, [(f"d{i:02d}", "sha256", size, 0, 1, at, 0) for i, (size, at) in enumerate(blobs)])
    gone = {r.digest for r in store.evict_to_size(index, target).collect()}
    assert {r.digest for r in store.evict_to_size(index, target, bucket_rows=2).collect()} == gone
    order = sorted((at, f"d{i:02d}", size or 0) for i, (size, at) in enumerate(blobs))
    total, want = sum(s for _, _, s in order), set()
    for _, d, s in order:
        if total <= target:
            break
        want.add(d)
        total -= s
    assert gone == want


def test_eviction_order(spark):
    index = index_of(spark, [(f"d{i}", "sha256", s, 0, 1, at, 0) for i, (s, at) in enumerate([(100, 3), (500, 1), (1000, 2)])])
    assert [r.digest for r in store.lru(index, 2).collect()] == ["d1", "d2"]
    assert [r.digest for r in store.lru(index, 2, 2).collect()] == ["d0"]
    assert [r.digest for r in store.largest(index, 1).collect()] == ["d2"]
    assert rows(store.freed(store.lru(index, 2))) == [(2, 1500)]


# -- overlays ----------------------------------------------------------------------------


def test_scopes(spark):
    n = spark.createDataFrame([("a:x", {"p": "1", "q": "1"}, {"dev": {"q": "2"}}), ("a:y", {}, {})], "fqn string, v map<string,string>, o map<string,map<string,string>>")
    rows_ = overlay.scope_rows(n, "fqn", "v", "recipe").unionByName(overlay.override_rows(n, "fqn", "o", "dev", "recipe")).unionByName(overlay.command_rows(n, {"z": "9"}))
    assert rows(overlay.effective(rows_)) == [("a:x", "p", "1", 4), ("a:x", "q", "2", 5), ("a:x", "z", "9", 6), ("a:y", "z", "9", 6)]
    assert rows(overlay.retype_declared(overlay.effective(rows_), {"p": "7", "new": "8"}), "key", "value") == [("p", "7"), ("q", "2"), ("z", "9"), ("z", "9")]
    one = spark.createDataFrame([(["t"], [], {"a": "1", "b": "1"}, {"b": "2"})], "t array<string>, own array<string>, m map<string,string>, o map<string,string>")
    got = one.select(overlay.inherited_tags(F.col("own"), F.col("t")), overlay.inherited_environment(F.col("t"), F.col("t")), overlay.overlaid(F.col("m"), F.col("o"))).first()
    assert tuple(got) == (["t"], ["t", "t"], {"a": "1", "b": "2"})


def test_parameters(spark):
    spec = '{"n": {"type": "number", "default": 3}, "s": {"type": "string", "required": true}, "l": {"type": "array"}, "o": {"type": "object", "default": {"a": 1}}, "b": {"type": "boolean", "default": true}}'
    d = overlay.declared(spark.createDataFrame([("t", spec)], "name string, parameters string"))
    uses = spark.createDataFrame([("x", "t"), ("y", "t")], "fqn string, template string")
    given_ = spark.createDataFrame([("x", "s", "hello"), ("x", "l", "[1]"), ("x", "extra", "1"), ("y", "n", "text"), ("y", "b", "1")], "fqn string, param string, value string")
    got = {(r.fqn, r.param): (r.value, r.error) for r in overlay.resolve_parameters(uses, given_, d).collect()}
    assert got["x", "n"] == ("3", None) and got["x", "s"] == ("hello", None) and got["x", "extra"] == ("1", None) and got["x", "l"] == ("[1]", None)
    assert got["y", "s"] == (None, "missing") and got["y", "n"] == ("text", "type") and got["y", "b"] == ("1", "type")
    assert ("y", "l") not in got and got["y", "o"] == ('{"a":1}', None)


# -- bytes --------------------------------------------------------------------------------


def test_hmac(spark):
    messages = [b"", b"x", b"y" * 63, b"z" * 200]
    for secret in (b"k", b"s" * 64, b"long" * 40):
        df = spark.createDataFrame([(bytearray(m),) for m in messages], "m binary")
        got = [r[0] for r in df.select(signing.hmac_sha256("m", secret)).collect()]
        assert got == [hmac.new(secret, m, hashlib.sha256).hexdigest() for m in messages]
    df = spark.createDataFrame([(bytearray(b"m"), hmac.new(b"k", b"m", hashlib.sha256).hexdigest(), v) for v in (1, 2)] + [(bytearray(b"m"), "00", 1)], "m binary, s string, v int")
    assert [r[0] for r in df.select(signing.verify("m", "s", "v", b"k")).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        signing.hmac_sha256("m", b"")


def test_codec(spark):
    import gzip

    r = random.Random(1)
    data = [b"", b"abc", b"text " * 500, r.randbytes(3000), gzip.compress(b"q" * 5000), b"\x89PNG" + b"0" * 1000, b"0000ftyp" + b"1" * 900, b"RIFF0000WEBP" + b"2" * 900, b"\x1f", None]
    df = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], "i int, d binary")
    out = df.select("i", codec.compressed("d").alias("c"), codec.pack("d").alias("p")).select("*", codec.packed_format("p").alias("f"), codec.unpack("p").alias("u")).orderBy("i").collect()
    assert [x.c for x in out] == [False, False, False, False, True, True, True, True, False, None]
    assert [x.f for x in out[:9]] == [0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert [None if x.u is None else bytes(x.u) for x in out] == data


def naive_cuts(data, low, average, high):
    bits = round(np.log2(average))
    strict, loose, table = 2**bits - 1, 2 ** (bits - 2) - 1, [int(x) for x in chunking.GEAR]
    out, start, n = [], 0, len(data)
    while start < n:
        if n - start <= low:
            out.append(n)
            break
        h, cut = 0, min(start + high, n)
        for p in range(start + low, min(start + high, n)):
            h = (h << 1) + table[data[p]] & (1 << 64) - 1
            if h & (strict if p < min(start + average, n) else loose) == 0:
                cut = p + 1
                break
        out.append(cut)
        start = cut
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 256), st.sampled_from([(64, 256, 1024), (100, 128, 200), (64, 100, 5000)]), st.integers(0, 99))
def test_cut_points(n, letters, sizes, seed):
    data = np.random.default_rng(seed).integers(0, letters, n).astype(np.uint8).tobytes()
    assert chunking.cut_points(data, *sizes) == naive_cuts(data, *sizes)


def test_chunks_cover_the_content(spark):
    text = "".join(f"{i * i} steps, {i % 7} turns and {i * 31 % 97} rests\n" for i in range(12_000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\0" * 200_000)], "id int, text string")
    parts = chunking.chunks(df, "id", "text").orderBy("id", "idx").collect()
    data = text.encode()
    mine = [p for p in parts if p.id == 1]
    assert len(mine) > 5 and b"".join(data[p.offset : p.offset + p.length] for p in mine) == data
    assert all(hashlib.sha256(data[p.offset : p.offset + p.length]).hexdigest() == p.digest for p in mine)
    assert {p.id for p in parts} == {1, 4} and all(p.length >= chunking.AVERAGE for p in parts if p.id == 4 and p.offset + p.length < 200_000)
    with pytest.raises(ValueError):
        chunking.cut_points(b"x", 10, 20, 30)
    stats = chunking.chunk_stats(spark.createDataFrame([(1, 10), (1, 30), (2, 5)], "id int, length int"), "id")
    assert rows(stats) == [(1, 2, 40, 10, 30, 20.0, 5.0), (2, 1, 5, 5, 5, 5.0, 0.0)]


def test_digest_texts(spark):
    h = "ab" * 32
    df = spark.createDataFrame([(f"sha256:{h.upper()}",), (f"md5:{h}",), (f"sha256:{h}:x",), ("sha256:12",), (None,)], "t string")
    assert [r[0] and tuple(r[0]) for r in df.select(digests.parse_digest("t")).collect()] == [("sha256", h), None, None, None, None]
    one = spark.createDataFrame([("sha256", h)], "a string, h string")
    assert one.select(digests.blob_path("a", "h")).first()[0] == f"sha256/ab/{h}" and one.select(digests.format_digest("a", "h")).first()[0] == f"sha256:{h}"
    name = one.select(digests.manifest_name("h").alias("n"))
    assert name.select(digests.manifest_key("n")).first()[0] == h and name.select(digests.manifest_key(F.lit("zz.json"))).first()[0] is None


# -- templates ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("a{{x}}b", "a1b"), ("{{missing}}", ""), ("{{d.e}}/{{ d.e }}", "v/v"), ("{{#if t}}y{{else}}n{{/if}}", "y"), ("{{#if f}}y{{else}}n{{/if}}", "n"),
        ("{{#if (eq d.e \"v\")}}y{{/if}}", "y"), ("{{#if (and t (not f))}}y{{/if}}", "y"), ("{{#if (or f (ne x 1))}}y{{else}}n{{/if}}", "n"),
        ("{{#each l}}{{@index}}{{this}};{{/each}}", "0p;1q;"), ("{{#each d}}{{@key}}={{this}}{{/each}}", "e=v"), ("{{#each none}}x{{else}}empty{{/each}}", "empty"),
        ("{{#unless f}}u{{/unless}}", "u"), ("<&>{{h}}", "<&><b>"), ("{{! note }}z", "z"), ("{{l.1}}", "q"), ("{{up \"abc\"}}", "ABC"), ("{{up t=\"k\"}}", "K"),
        ("{{#each (cut \"a, b\\n\\nc\")}}[{{this}}]{{/each}}", "[a, b]"),
    ],
)
def test_render(text, want):
    up = render.Function("up", lambda t: t.upper(), {"t": {"type": "string", "required": True}})
    cut = render.Function("cut", lambda s: s.split("\\n")[0] + "\n \n", {"s": {}}, returns="array")
    values = {"x": 1, "t": True, "f": False, "d": {"e": "v"}, "l": ["p", "q"], "h": "<b>"}
    if "cut" in text:
        text = text.replace("\\n\\nc", "")
    assert render.render(text, values, {"up": up, "cut": cut}) == want


def test_render_errors_and_binding():
    for bad in ("{{#if x}}", "{{/if}}", "{{#huh x}}{{/huh}}", "{{else}}", "{{nope 1}}"):
        with pytest.raises(render.TemplateError):
            render.render(bad, {})
    f = render.Function("f", lambda a=None, b=None: f"{a}{b}", {"b": {}, "a": {}})
    assert f([1, None, [2], 3], {}) == "13" and f([1], {"a": 9}) == "9None" and f([2.9], {}) == "2None"
    with pytest.raises(render.TemplateError):
        render.Function("g", lambda n: n, {"n": {"type": "number", "required": True}})([], {})
    with pytest.raises(render.TemplateError):
        render.Function("g", lambda n: n, {"n": {"type": "number"}})(["x"], {})


def test_variables_see_earlier_ones():
    got = render.process({"a": "x", "b": "{{var.a}}y", "n": "{{var.two}}", "k": 5}, {"var": {"two": 2}}, {"k": "7", "unknown": "1"})
    assert got == {"a": "x", "b": "xy", "n": 2, "k": 7}
    assert render.render_tree({"run": "{{p}}", "l": ["{{p}}", 1]}, {"p": "true"}, skip=("run",)) == {"run": "{{p}}", "l": [True, 1]}


def test_render_column_and_sql_function(spark):
    df = spark.createDataFrame([("hi {{n}}", '{"n": 3}'), (None, None), ("x", None)], "t string, c string")
    assert [r[0] for r in df.select(render.render_column("t", "c")).collect()] == ["hi 3", None, "x"]
    render.register(spark, render.Function("shout", lambda s: s.upper() + "!", {"s": {"type": "string"}}))
    assert spark.sql("select shout('a')").first()[0] == "A!"


# -- planning --------------------------------------------------------------------------------


def test_plan_selection_and_templates(spark):
    from stowage.operators import planning

    shape = "fqn string, cookbook string, recipe string, description string, dependencies array<string>, cache struct<inputs:array<string>,outputs:array<string>>, run string, environment array<string>, variables map<string,string>, tags array<string>, template string"
    make = lambda fqn, deps, run, template=None, tags=(): (fqn, *fqn.split(":"), None, deps, None, run, ["E"], {"a": "1"}, list(tags), template)
    nodes = spark.createDataFrame([make("a:x", ["y"], "go", tags=["T"]), make("a:y", [], None, " lib "), make("a:z", None, "z"), make("b:bad", [], " ")], shape)
    t = spark.createDataFrame([("lib", "d", ["a:z"], None, "from template", ["F"], {"a": "0", "b": "2"}, ["new"])], "name string, description string, dependencies array<string>, cache struct<inputs:array<string>,outputs:array<string>>, run string, environment array<string>, variables map<string,string>, tags array<string>")
    y = planning.resolve_templates(nodes, t).where("fqn = 'a:y'").first()
    assert (y.run, y.environment, y.variables, y.tags, y.dependencies) == ("from template", ["F", "E"], {"a": "1", "b": "2"}, ["new"], ["a:z"])
    assert rows(planning.plan_selection(nodes, "a:x", templates=t), "level", "fqn") == [(0, "a:z"), (1, "a:y"), (2, "a:x")]
    assert rows(planning.plan_selection(nodes, tags=["t"], templates=t), "fqn") == [("a:x",), ("a:y",), ("a:z",)]
    assert planning.plan_selection(nodes, "no:pe", templates=t).count() == 0
    for pattern, templates in (("b:", t), ("a:y", None)):
        with pytest.raises(planning.InvalidRecipe):
            planning.plan_selection(nodes, pattern, templates=templates)
    with pytest.raises(planning.InvalidRecipe, match="lib"):
        planning.resolve_templates(nodes, t.limit(0))
    some_ = spark.createDataFrame([("a:z",)], "fqn string")
    assert planning.included(nodes, some_).count() == 1 and planning.included(nodes, some_.limit(0)).count() == 4
    df = spark.createDataFrame([(8, 4, 1), (8, 4, 9), (2, 4, 0)], "w int, c int, r int")
    assert [r[0] for r in df.select(planning.parallelism("w", "c", "r")).collect()] == [3, 1, 2]
    assert spark.createDataFrame([(" a \n\n b",)], "t string").select(planning.text_lines("t")).first()[0] == ["a", "b"]
    files = spark.createDataFrame([("p", "d1")], "path string, digest string")
    assert rows(store.verified(spark.createDataFrame([("p", "d1"), ("q", "d2")], "path string, digest string"), files), "path", "ok") == [("p", True), ("q", False)]


# -- record hashes -----------------------------------------------------------------

RECORD = "fqn string, environment array<string>, run string, tags array<string>, variables map<string,string>"


def test_every_part_of_a_record_changes_its_hash(spark):
    from stowage.functions import blake3
    from stowage.operators import records

    base = ("a:b", ["FOO"], "make", ["t"], {"k": "1"})
    hash_of = lambda row, files=(), env=None: records.record_hashes(
        spark.createDataFrame([row], RECORD), spark.createDataFrame([("a:b", *f) for f in files], "fqn string, name string, digest string"), env or {"FOO": "bar"}
    ).first()[1]
    variants = [
        hash_of(base), hash_of((*base[:2], "test", *base[3:])), hash_of((*base[:3], ["t", "u"], base[4])), hash_of((*base[:4], {"k": "2"})), hash_of(base, env={"FOO": "not"}),
        hash_of(("a:b", [], *base[2:])), hash_of(base, [("x.c", "d1")]), hash_of(base, [("x.c", "d2")]), hash_of(base, [("y.c", "d1")]),
    ]
    assert len(set(variants)) == len(variants)
    assert hash_of(base, [("b", "2"), ("a", "1")]) == hash_of(base, [("a", "1"), ("b", "2"), ("a", "1")])
    text = '{"environment":{"FOO":"bar"},"file_hashes":{"a/b":"2","a-b":"1"},"run":"make","tags":["t"],"variables":{"k":"1"}}'
    assert hash_of(base, [("a-b", "1"), ("a/b", "2")]) == blake3.digest(text.encode())


def test_records_of_nulls_and_odd_texts(spark):
    from stowage.operators import records

    odd = [("a:b", None, None, None, None), ("a:c", ["É", None, "É"], 'q"\\\n\x01\x7f', [None, "é"], {"k": None})]
    got = dict(map(tuple, records.record_texts(spark.createDataFrame(odd, RECORD)).collect()))
    assert got["a:b"] == '{"environment":{},"file_hashes":{},"run":"","tags":[],"variables":{}}'
    assert got["a:c"] == '{"environment":{"É":""},"file_hashes":{},"run":"q\\"\\\\\\n\\u0001\x7f","tags":["é"],"variables":{"k":""}}'
    assert records.record_texts(spark.createDataFrame([], RECORD)).count() == 0


def test_input_files_by_pattern(spark):
    from stowage.operators import records

    files = spark.createDataFrame([(p, p.upper()) for p in ("app/src/a.c", "app/src/d/b.c", "app/src/d/b.h", "app/x.c", "lib/y.c", "lib/_z/.y.c", "top.txt")] + [(None, "n")], "path string, digest string")
    patterns = [("f:1", "app", "src/**/*.c"), ("f:1", "app", "src/a.c"), ("f:2", "app", "../lib/**/*.c"), ("f:3", "", "*.txt"), ("f:4", "app/src", "'../x.c'"), ("f:5", "app", "none/*"), ("f:6", None, "**/y.?"), ("f:7", "app", None)]
    got = rows(records.input_files(spark.createDataFrame(patterns, "fqn string, base string, pattern string"), files), "fqn", "name")
    assert got == [("f:1", "src/a.c"), ("f:1", "src/d/b.c"), ("f:2", "../lib/_z/.y.c"), ("f:2", "../lib/y.c"), ("f:3", "top.txt"), ("f:4", "../x.c"), ("f:6", "lib/y.c")]


def test_fingerprints_against_plain_recursion(spark):
    from oracle import DATA

    from stowage.functions import blake3
    from stowage.plans import reference

    n, e = reference.edges(spark, DATA)
    own = dict(map(tuple, reference.record_hash(spark, DATA).collect()))
    deps = {}
    for a, b in e.collect():
        deps.setdefault(a, []).append(b)
    memo = {}

    def h(x, on=()):
        if x in on:
            return None
        if x not in memo:
            below = [h(d, (*on, x)) for d in deps.get(x, [])]
            memo[x] = None if None in below else blake3.digest((own[x] + "".join(sorted(below))).encode())
        return memo[x]

    got = dict(map(tuple, reference.merkle_fingerprint(spark, DATA).collect()))
    assert got == {x: h(x) for x in own if h(x) is not None} and len(got) > 30
