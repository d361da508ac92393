"""Queries of sources and sinks (written below the shared folder, read back, removed),
and of operators whose inputs the tables do not hold as they stand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, digests, render, signing, versions
from ..operators import overlay, planning, selection, store
from ..session import cut, remove_folder, shared_folder, table
from ..sources import catalog, files, walk
from ..streaming import index
from . import problems, reference
from .problems_sql import trim
from .reference import SECRET, V, query


def _kept(spark: SparkSession, name: str, make: Callable[[str], DataFrame]) -> DataFrame:
    """What ``make`` reads from a folder of its own, which is removed then."""
    root = walk.absolute(shared_folder(spark, name))
    out = cut(make(root))
    remove_folder(spark, root)
    return out


def _texts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))


@query("select distinct sha256(text) as digest, octet_length(encode(text))::bigint as size from documents where text is not null")
def blob_round_trip(spark, sf):
    """Texts put twice into a store of shards: each content is held once."""

    def make(root: str) -> DataFrame:
        files.put_blobs(_texts(spark, sf), root)
        files.put_blobs(_texts(spark, sf), root)
        return files.read_blobs(spark, root).select(F.sha2("content", 256).alias("digest"), "size")

    return _kept(spark, "blobs", make)


@query(V + "select distinct 'sha256' as algorithm, sha256(name) as digest from temps")
def blob_listing(spark, sf):
    """Names of blobs written as files, listed from the folder."""
    t = reference.templates(spark, sf).select(F.sha2("name", 256).alias("d"), F.encode("name", "UTF-8").alias("content")).distinct()

    def make(root: str) -> DataFrame:
        path = F.concat(F.lit(root + "/"), digests.blob_path(F.lit("sha256"), "d", "cas"))
        walk.write_files(t.select(path.alias("path"), "content").unionByName(t.limit(1).select(F.lit(f"{root}/cas/sha256/zz/other").alias("path"), "content")))
        return files.list_blobs(spark, root)

    return _kept(spark, "listing", make)


_LAST_RUN = "with e as (select *, row_number() over (partition by action_key order by execution_id desc, recorded_at desc) as rn from executions where action_key is not null)"


def _manifests(spark, sf) -> DataFrame:
    e = table(spark, sf, "executions").where("action_key is not null")
    last = F.max_by(F.struct("recipe", "exit_code", "stdout_digest", "stderr_digest"), F.struct("execution_id", "recorded_at")).alias("x")
    return e.groupBy("action_key").agg(last).select("action_key", "x.*")


@query(_LAST_RUN + "select action_key, recipe, exit_code, stdout_digest from e where rn = 1")
def manifest_round_trip(spark, sf):
    """Manifests as files ``<hex of the key>.json``, read back with their keys."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("outputs", "array<struct<path:string>>"), ("execution_metadata", "struct<hostname:string>"))]

    def make(root: str) -> DataFrame:
        files.write_manifest_files(_manifests(spark, sf).select("*", *nothing), root)
        return files.read_manifest_files(spark, root).select("action_key", "recipe", "exit_code", "stdout_digest")

    return _kept(spark, "manifests", make)


@query(V + "select replace(fqn, ':', '.') || '.log' as name, octet_length(encode(coalesce(run, '') || coalesce(description, '')))::bigint as size from nodes")
def log_files(spark, sf):
    logs = reference.nodes(spark, sf).select("fqn", F.col("run").alias("stdout"), F.col("description").alias("stderr"))

    def make(root: str) -> DataFrame:
        files.write_log_files(logs, root)
        return walk.list_files(spark, root).select(F.substring_index("path", "/", -1).alias("name"), "size")

    return _kept(spark, "logs", make)


def _catalog(spark, sf, root: str) -> DataFrame:
    """(path, content) of one catalog file per folder and namespace, written as JSON
    (which YAML reads); every third folder lies below one that begins with ``_``."""
    n = reference.nodes(spark, sf)
    body = F.struct(
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("run", F.lit("")).alias("run"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.filter(F.transform("dependencies", digests.trimmed), lambda x: x != "").alias("dependencies"), F.coalesce("environment", F.array().cast("array<string>")).alias("environment"),
    )
    own = n.select(digests.directory("config_path").alias("dir"), "cookbook", F.struct("recipe", body.alias("body")).alias("r")).where("cookbook is not null and recipe is not null")
    per = own.groupBy("dir", "cookbook").agg(F.map_from_entries(F.array_sort(F.collect_list("r"))).alias("recipes"))
    top = F.when(F.pmod(F.xxhash64("cookbook"), F.lit(3)) == 0, F.lit("_own/")).otherwise(F.lit(""))
    path = F.concat(F.lit(root + "/"), top, F.coalesce("dir", F.lit("")), F.lit("/"), F.col("cookbook"), F.lit(".cookbook.yml"))
    content = F.encode(F.to_json(F.struct(F.col("cookbook").alias("name"), "recipes")), "UTF-8")
    return per.select(path.alias("path"), content.alias("content"))


_READ = "array_to_string(list_transform(list_filter(list_transform(coalesce(dependencies, []), lambda d: " + trim("d") + "), lambda d: d <> ''), lambda d: case when contains(d, ':') then d else cookbook || ':' || d end), ',')"


@query(V + f"select fqn, coalesce(run, '') as run, array_to_string(coalesce(tags, []), ',') as tags, {_READ} as dependencies, array_to_string(list_concat(['CI'], coalesce(environment, [])), ',') as environment from nodes")
def catalog_nodes(spark, sf):
    """Nodes read from a tree of catalog files; ignored files of the tree are left out."""

    def make(root: str) -> DataFrame:
        walk.write_files(_catalog(spark, sf, root))
        broken = [(f"{root}/{p}", t.encode()) for p, t in ((".own", "broken/\n"), ("broken/x.cookbook.yml", "name: ["), (".hidden/cookbook.yml", "name: ["))]
        walk.write_files(spark.createDataFrame(broken, "path string, content binary"))
        n = catalog.read_nodes(spark, root, {"environment": ["CI"]}, ignore_files=(".own",))
        joined = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(c) for c in ("tags", "dependencies", "environment")]
        return n.select("fqn", F.coalesce("run", F.lit("")).alias("run"), *joined)

    return _kept(spark, "catalog", make)


# -- index, codec, signatures -----------------------------------------------------------


@query(
    V
    + """, p as (select digest, split_part(digest, ':', 1) as algorithm, arg_max_null(size, output_id) as size, arg_max_null(t, output_id) as t from (
    select o.digest, o.output_id, o.size, epoch_us(f.written_at) // 1000000 as t from outs o join (select output_id, max(written_at) as written_at from output_files group by 1) f using (output_id)) group by digest)
select coalesce(p.digest, i.digest) as digest, coalesce(p.algorithm, i.algorithm) as algorithm, case when p.digest is null then i.size else p.size end as size,
  case when p.digest is null then i.stored_at else p.t end as stored_at, case when p.digest is null then i.access_count else 1 end as access_count,
  case when p.digest is null then i.last_accessed else p.t end as last_accessed, case when p.digest is null then i.compression_format else 0 end as compression_format
from idx i full join p on i.digest = p.digest"""
)
def index_replace(spark, sf):
    """Files put over an index of older rows: their rows are replaced whole, counters begin anew."""
    at = table(spark, sf, "output_files").groupBy("output_id").agg(F.unix_seconds(F.max("written_at").cast("timestamp")).alias("at"))
    puts = reference.outputs(spark, sf).join(at, "output_id").select("digest", F.substring_index("digest", ":", 1).alias("algorithm"), "size", "at", "output_id")
    new = store.new_rows(puts.groupBy("digest").agg(F.max_by(F.struct("algorithm", "size", "at"), "output_id").alias("x")).select("digest", "x.*"))
    return store.upsert(reference.index(spark, sf), new)


_HEADS = [*codec.MAGIC, "00" * 8 + "57454250", "00" * 4 + "66747970", "1f8c", "00" * 7 + "57454250", ""]


@query(
    f"select doc_id, ({' or '.join(f'doc_id % {len(_HEADS)} = {i}' for i in range(len(codec.MAGIC) + 2))}) and octet_length(unhex([{', '.join(repr(h) for h in _HEADS)}][doc_id % {len(_HEADS)} + 1]) || encode(text)) >= 4 as compressed from documents where text is not null"
)
def sniffed_contents(spark, sf):
    """Texts behind the first bytes of some format, or of none."""
    heads = F.array(*[F.unhex(F.lit(h)) for h in _HEADS])
    data = F.concat(F.element_at(heads, (F.pmod("doc_id", F.lit(len(_HEADS))) + 1).cast("int")), F.col("content"))
    return _texts(spark, sf).select("doc_id", codec.compressed(data).alias("compressed"))


@query("select doc_id, octet_length(encode(text)) >= 512 as tried, case when octet_length(encode(text)) < 512 then octet_length(encode(text)) + 1 end as plain_size from documents where text is not null")
def compression_decisions(spark, sf):
    """What is packed: contents from 512 bytes on are tried; smaller ones stay as they are."""
    rows = _texts(spark, sf).withColumns({"tried": codec.worth_trying("content"), "packed": codec.pack("content")})
    return rows.select("doc_id", "tried", F.when(~F.col("tried") & (codec.packed_format("packed") == 0), F.octet_length("packed")).alias("plain_size"))


@query("select action_key, action_key like '%a' as ok from (select distinct action_key from executions where action_key is not null)")
def hmac_verified(spark, sf):
    """Signatures of keys; those of keys that do not end with an a are spoilt."""
    keys = table(spark, sf, "executions").where("action_key is not null").select("action_key").distinct()
    good = signing.hmac_sha256("action_key", SECRET)
    signed = keys.withColumn("signature", F.when(F.col("action_key").like("%a"), good).otherwise(F.reverse(good)))
    return signed.select("action_key", signing.verify("action_key", "signature", F.lit(signing.VERSION), SECRET).alias("ok"))


# -- templates and overlays -------------------------------------------------------------


@query(V + f"select name as fqn, {trim('extends')} as template from temps where extends is not null and {trim('extends')} not in (select name from temps)")
def unknown_parents(spark, sf):
    """Uses of templates that do not exist: the parents that templates name."""
    t = reference.templates(spark, sf)
    uses = t.where("extends is not null").select(F.col("name").alias("fqn"), digests.trimmed("extends").alias("template"))
    return overlay.unknown_templates(uses, t).select("fqn", "template")


@query(V + "select name, contains(template_content, '{{') and contains(template_content, '}}') as template from temps")
def template_markers(spark, sf):
    return reference.templates(spark, sf).select("name", selection.has_template("template_content").alias("template"))


@query(
    V
    + """select fqn, case when variables['mode'] = 'prod' then 'P' when variables['mode'] is not null then upper(variables['mode'][1]) || variables['mode'][2:] else 'none' end || '|' ||
  array_to_string(list_transform(coalesce(tags, []), lambda t, i: (i - 1) || '=' || t || ';'), '') || '|' || case when len(coalesce(tags, [])) > 0 then 'tagged' else 'bare' end as text from nodes"""
)
def template_logic(spark, sf):
    """Conditions, loops, a function and values that are missing."""
    text = "{{#if mode}}{{#if (eq mode \"prod\")}}P{{else}}{{capital mode}}{{/if}}{{else}}none{{/if}}|{{#each tags}}{{@index}}={{this}};{{/each}}|{{#if tags}}tagged{{else}}bare{{/if}}"
    capital = render.Function("capital", lambda word: word[:1].upper() + word[1:], {"word": {"type": "string", "required": True}})
    context = F.to_json(F.struct(F.col("variables")["mode"].alias("mode"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")))
    return reference.nodes(spark, sf).select("fqn", render.render_column(F.lit(text), context, {"capital": capital}).alias("text"))


@query(
    V
    + """, s as (select fqn, e.key as key, 4 as rank, e.value as value from (select fqn, unnest(map_entries(variables)) as e from nodes)
  union all select fqn, e.key, 5, e.value || '!' from (select fqn, unnest(map_entries(variables)) as e from nodes) where e.key = 'mode')
select fqn, key, case when key = 'level' then 'given' else value end as value, rank from (select *, row_number() over (partition by fqn, key order by rank desc) as rn from s) where rn = 1"""
)
def overlay_overrides(spark, sf):
    """An environment's overrides above the nodes' own values; given ones replace declared keys only."""
    n = reference.nodes(spark, sf)
    spoilt = F.transform_values(F.map_filter("variables", lambda k, _: k == "mode"), lambda _, v: F.concat(v, F.lit("!")))
    blocks = n.where("variables is not null").select("fqn", F.create_map(F.lit("dev"), spoilt, F.lit("prod"), F.col("variables")).alias("overrides"))
    rows = overlay.scope_rows(n, "fqn", "variables", "recipe").unionByName(overlay.override_rows(blocks, "fqn", "overrides", "dev", "recipe"))
    return overlay.retype_declared(overlay.effective(rows), {"level": "given", "absent": "x"})


# -- plans ---------------------------------------------------------------------------------


@query(V + "select fqn from nodes where fqn in (select trim(fqn) from graph_nodes where node_index % 2 = 0)")
def included_nodes(spark, sf):
    named = table(spark, sf, "graph_nodes").where("node_index % 2 = 0").select(F.trim("fqn").alias("fqn"))
    return planning.included(reference.nodes(spark, sf), named).select("fqn")


@query("select distinct execution_id, greatest(1, least(8, execution_id % 5 + 1 - 2)) as tasks from executions")
def task_limits(spark, sf):
    e = table(spark, sf, "executions").select("execution_id").distinct()
    return e.select("execution_id", planning.parallelism(F.lit(8), F.col("execution_id") % 5 + 1, F.lit(2)).cast("bigint").alias("tasks"))


@query("with e as (select columns('.*_version') as version from executions) select distinct version, regexp_replace('v' || version, '^v', '') as plain from e where version is not null")
def plain_versions(spark, sf):
    e = table(spark, sf, "executions")
    v = e.select(F.col(reference.version_column(e)).alias("version")).where("version is not null").distinct()
    return v.select("version", versions.without_v(F.concat(F.lit("v"), F.col("version"))).alias("plain"))


@query(V + ", k as (select distinct digest from idx where compression_format = 1) select o.digest, bool_or(o.size % 2 = 0 or k.digest is not null) as ok from outs o left join k on o.digest = k.digest where o.size is not null group by o.digest")
def layered_writes(spark, sf):
    """A write holds if that of one tier did."""
    o = reference.outputs(spark, sf).where("size is not null")
    there = reference.index(spark, sf).where("compression_format = 1").select("digest", F.lit(True).alias("there"))
    both = o.select("digest", (F.col("size") % 2 == 0).alias("ok")).unionByName(o.join(there, "digest", "left").select("digest", F.coalesce("there", F.lit(False)).alias("ok")))
    return store.any_success(both)


@query(
    V
    + """, p as (select key as digest, split_part(key, ':', 1) as algorithm, stored_at, max(size) as size, row_number() over (partition by key order by stored_at desc) as rn from blob_keys where stored_at is not null group by key, stored_at),
a as (select digest, count(*) as n, max(epoch_us(f.written_at) // 1000000) as t from outs o join (select output_id, max(written_at) as written_at from output_files group by output_id) f using (output_id) where f.written_at is not null group by digest)
select p.digest, p.algorithm, p.size, p.stored_at, 1 + coalesce(a.n, 0) as access_count, greatest(p.stored_at, a.t) as last_accessed from p left join a on p.digest = a.digest where rn = 1"""
)
def streamed_index(spark, sf):
    """The index that a stream of puts and accesses keeps."""
    keyed = problems.blob_rows(spark, sf).where("stored_at is not null")
    puts = keyed.groupBy(F.col("key").alias("digest"), F.col("stored_at").alias("at")).agg(F.max("size").alias("size"))
    puts = puts.select(F.lit("put").alias("kind"), "digest", F.substring_index("digest", ":", 1).alias("algorithm"), "size", "at")
    at = table(spark, sf, "output_files").groupBy("output_id").agg(F.unix_seconds(F.max("written_at").cast("timestamp")).alias("at")).where("at is not null")
    null = F.lit(None)
    accesses = reference.outputs(spark, sf).join(at, "output_id").select(F.lit("access").alias("kind"), "digest", null.cast("string").alias("algorithm"), null.cast("bigint").alias("size"), "at")

    def make(root: str) -> DataFrame:
        events = puts.unionByName(accesses)
        events.write.parquet(root + "/in")
        stream = spark.readStream.schema(events.schema).parquet(root + "/in")
        index.maintain(stream, root + "/index", root + "/progress").awaitTermination()
        last = index.read_version(spark, root + "/index", 0)
        return last.select("digest", "algorithm", "size", "stored_at", "access_count", "last_accessed")

    return _kept(spark, "stream", make)


_TREE = "with t as (select distinct sha256(name)[1:12] as h, name from recipe_templates where name is not null), f as (select h || '/__init__.py' as path, name as body from t union all select '_gen/' || h || '.py', name || 'g' from t union all select '.env/' || h || '.txt', name from t) "


def _tree(spark, sf, root: str) -> None:
    """Three files for every template, below names that begin with ``_`` and ``.``."""
    t = table(spark, sf, "recipe_templates").where("name is not null").select("name", F.substring(F.sha2("name", 256), 1, 12).alias("h")).distinct()
    ways = F.array(
        F.struct(F.concat("h", F.lit("/__init__.py")).alias("p"), F.col("name").alias("b")),
        F.struct(F.concat(F.lit("_gen/"), "h", F.lit(".py")).alias("p"), F.concat("name", F.lit("g")).alias("b")),
        F.struct(F.concat(F.lit(".env/"), "h", F.lit(".txt")).alias("p"), F.col("name").alias("b")),
    )
    each = t.select(F.explode(ways).alias("x"))
    walk.write_files(each.select(F.concat(F.lit(root + "/"), "x.p").alias("path"), F.encode("x.b", "UTF-8").alias("content")))


@query(_TREE + "select path, octet_length(encode(body))::bigint as size, sha256(body) as digest from f where path like '%.py'")
def tree_scan(spark, sf):
    """Files of a tree that match a pattern, with their contents' digests."""

    def make(root: str) -> DataFrame:
        _tree(spark, sf, root)
        return files.read_files(spark, root, patterns=["**/*.py"]).select("path", "size", F.sha2("content", 256).alias("digest"))

    return _kept(spark, "tree", make)


@query(_TREE + "select path from f where path like '.env/%' or path like '\\_gen/%' escape '\\'")
def output_expansion(spark, sf):
    """Files at or below declared outputs, of which one does not exist."""

    def make(root: str) -> DataFrame:
        _tree(spark, sf, root)
        outputs = spark.createDataFrame([("_gen",), (".env",), ("absent",)], "path string")
        return files.expand_outputs(files.read_files(spark, root, contents=False), outputs).select("path")

    return _kept(spark, "tree", make)
