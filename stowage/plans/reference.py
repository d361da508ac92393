"""Queries of the graph, selection, store and overlay operators over whole tables,
each with the SQL it is checked against (``SQL``; none where SQL is too slow or
cannot express the operator, which tests then check by brute force)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blake3, chunking, codec, digests, render, signing, versions
from ..operators import graph, overlay, planning, records, selection, store
from ..session import cut, table
from . import problems
from .problems_sql import VIEWS, trim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- records -------------------------------------------------------------------------


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Current recipes as node records."""
    loads = problems.recipe_loads(spark, sf)
    cols = ("cookbook", "recipe", "description", "tags", "dependencies", "environment", "variables", "run", "cache", "template", "parameters", "config_path", "removed_at")
    out = problems.latest(loads, "name", "recipe_id", *cols)
    return out.withColumnsRenamed({"name": "fqn", "recipe_id": "place"})


def templates(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "recipe_templates").where("name is not null")
    return problems.latest(t, "name", "template_id", "description", "extends", "parameters", "template_content")


def index(spark: SparkSession, sf: str) -> DataFrame:
    """The blob index: of each digest key the last put."""
    rows = problems.blob_rows(spark, sf)
    algorithm = F.substring_index("key", ":", 1).alias("algorithm")
    puts = rows.select("blob_id", F.col("key").alias("digest"), algorithm, "size", "stored_at", "access_count", "last_accessed", "compression_format")
    cols = ("algorithm", "size", "stored_at", "access_count", "last_accessed", "compression_format")
    return problems.latest(puts, "digest", "blob_id", *cols).drop("blob_id")


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Files with a well-formed digest, each output_id once."""
    rows = table(spark, sf, "output_files").where("digest is not null").withColumn("key", digests.digest_key("digest"))
    rows = rows.where(digests.is_well_formed(F.col("key")))
    return problems.latest(rows, "output_id", "recorded_at", "execution_id", "path", "key", "size", "is_executable").withColumnRenamed("key", "digest")


def version_column(executions: DataFrame) -> str:
    """The column with the version of the tool that ran: the one whose name ends so."""
    (name,) = (c for c in executions.columns if c.endswith("_version"))
    return name


def edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = nodes(spark, sf)
    return n, graph.edges(n)


V = (
    f"with recursive {VIEWS},"
    + """
nodes as (select name as fqn, * exclude (name, fqn, rn) from current_recipe),
edges as (select r.name as src, r.ref as dst from refs r where r.ref in (select fqn from nodes)),
idx as (
  select key as digest, split_part(key, ':', 1) as algorithm, size, stored_at, access_count, last_accessed, compression_format
  from (select *, row_number() over (partition by key order by blob_id desc) as rn from blob_keys) where rn = 1
),
outs as (
  select output_id, execution_id, path, key as digest, size, is_executable from (
    select *, row_number() over (partition by output_id order by recorded_at desc nulls last) as rn from file_keys
    where digest is not null and regexp_full_match(key, '(blake3|sha256):[0-9a-f]{64}')
  ) where rn = 1
),
temps as (select * exclude rn from (select *, row_number() over (partition by name order by template_id desc) as rn from recipe_templates where name is not null) where rn = 1)
"""
)
#: The closure, the nodes that reach a cycle, and every (node, way length) off them.
CLOSURE = V + ", reach(src, dst) as (select src, dst from edges union select r.src, e.dst from reach r join edges e on r.dst = e.src)"
LEVELS = (
    CLOSURE
    + """,
ring as (select src from reach where src = dst),
bad as (select src from ring union select r.src from reach r join ring g on r.dst = g.src),
good as (select fqn from nodes where fqn not in (select src from bad)),
ways(fqn, level) as (
  select fqn, 0 from good where fqn not in (select src from edges)
  union select e.src, w.level + 1 from ways w join edges e on e.dst = w.fqn where e.src in (select fqn from good)
),
plan as (select max(level) as level, fqn from ways group by fqn)
"""
)

# -- graph ----------------------------------------------------------------------------


@query(LEVELS + "select cast(level as bigint) as level, fqn from plan")
def plan_levels(spark, sf):
    return graph.levels(*edges(spark, sf))


@query(LEVELS + "select cast(sum(n) as bigint) as recipes, count(*) as levels, max(n) as widest from (select level, count(*) as n from plan group by level)")
def plan_stats(spark, sf):
    return graph.plan_statistics(plan_levels(spark, sf))


@query(LEVELS + "select p.level::bigint as level, p.fqn, n.run, n.template from plan p join nodes n on p.fqn = n.fqn")
def plan_materialized(spark, sf):
    return graph.materialize(plan_levels(spark, sf), nodes(spark, sf)).select("level", "fqn", "run", "template")


@query(CLOSURE + "select src as fqn, count(*) as dependencies from reach where src <> dst group by src")
def closure_counts(spark, sf):
    """How many nodes each one depends on, directly or not."""
    return graph.dependency_counts(*edges(spark, sf))


@query(V + "select name as src, ref as dst from refs where ref not in (select fqn from nodes)")
def missing_dependencies(spark, sf):
    return graph.missing_dependencies(nodes(spark, sf))


@query(CLOSURE + "select a.src as fqn, least(a.src, min(b.dst)) as first from reach a join reach b on a.src = b.src and exists (select 1 from reach c where c.src = b.dst and c.dst = a.src) where a.src = a.dst group by a.src")
def cycle_members(spark, sf):
    rows = graph.cycles(*edges(spark, sf))
    least = rows.groupBy("cycle").agg(F.min("fqn").alias("first"))
    return rows.join(least, "cycle").select("fqn", "first")


@query(
    LEVELS
    + """, wanted as (select fqn from plan where fqn like '%:release' union select r.dst from reach r join plan p on r.src = p.fqn where p.fqn like '%:release')
select cast(p.level as bigint) as level, p.fqn from plan p join wanted w on p.fqn = w.fqn"""
)
def plan_for_targets(spark, sf):
    """The plan of all ``release`` steps and what they depend on."""
    n, e = edges(spark, sf)
    good = cut(n.join(graph.levels(n, e), "fqn", "left_semi"))
    return graph.plan_for(selection.select_exact(good, ":release").select("fqn"), good, graph.edges(good))


@query(
    LEVELS
    + """, picked as (select fqn from nodes where regexp_matches(recipe, '^(lint|format)') and list_has_any(list_transform(tags, lambda x: lower(x)), ['infra', 'fast']) and fqn in (select fqn from good)),
wanted as (select fqn from picked union select r.dst from reach r join picked p on r.src = p.fqn)
select cast(p.level as bigint) as level, p.fqn from plan p join wanted w on p.fqn = w.fqn"""
)
def plan_selection(spark, sf):
    """A pattern and tags, over the nodes that reach no cycle and have a command."""
    n, e = edges(spark, sf)
    good = cut(n.join(graph.levels(n, e), "fqn", "left_semi").withColumn("run", F.when(F.trim(F.coalesce("run", F.lit(""))) == "", F.lit("true")).otherwise(F.col("run"))))
    return planning.plan_selection(good, ":^(lint|format)", True, ["Infra", "fast"])


@query(V + "select fqn, unnest(list_filter(list_transform(string_split(run, chr(10)), lambda x: trim(x)), lambda x: x <> '')) as line from nodes")
def command_lines(spark, sf):
    return nodes(spark, sf).select("fqn", F.explode(planning.text_lines("run")).alias("line"))


@query("select action_key, count(*) filter (exit_code = 0) > 0 as present from executions where action_key is not null group by action_key")
def manifests_exist(spark, sf):
    e = table(spark, sf, "executions").where("action_key is not null")
    return store.manifests_exist(e.select("action_key").distinct(), store.succeeded(e))


@query("select distinct action_key from executions where action_key is not null and action_key not in (select action_key from executions where exit_code <> 0 and action_key is not null)")
def manifests_kept(spark, sf):
    """Without the results of actions that ever failed."""
    e = table(spark, sf, "executions").where("action_key is not null")
    return store.delete_manifests(e, e.where("exit_code <> 0")).select("action_key").distinct()


@query(V + ", t as (select path, max(digest) as have from outs where is_executable group by path) select output_id, coalesce(t.have = o.digest, false) as ok from outs o left join t on o.path = t.path")
def verify_contents(spark, sf):
    o = outputs(spark, sf)
    return store.verified(o, o.where("is_executable")).select("output_id", "ok")


@query(V + "select e.src, e.dst from edges e where e.src in (select fqn from nodes where list_contains(tags, 'backend')) and e.dst in (select fqn from nodes where list_contains(tags, 'backend'))")
def tag_subgraph(spark, sf):
    n, e = edges(spark, sf)
    return graph.subgraph(e.distinct(), selection.select_tags(n, ["backend"]))


@query(V + f"select distinct {trim('g.fqn')} as fqn from graph_nodes g where {trim('g.fqn')} <> '' and {trim('g.fqn')} not in (select fqn from nodes)")
def unknown_targets(spark, sf):
    registered = table(spark, sf, "graph_nodes").select(digests.trimmed("fqn").alias("fqn")).where("fqn <> ''").distinct()
    return graph.unknown_targets(registered, nodes(spark, sf))


@query(V + f"select fqn from nodes where fqn not in (select {trim('fqn')} from graph_nodes where fqn is not null)")
def added_nodes(spark, sf):
    registered = table(spark, sf, "graph_nodes").select(digests.trimmed("fqn").alias("fqn")).where("fqn is not null")
    return graph.added(nodes(spark, sf), registered)


#: Values of environment names that are set; all others are unset.
VALUES = {"LOG_LEVEL": 'in"fo', "REGION_CODE": "é\n1"}


def record_files(spark, sf, n: DataFrame) -> DataFrame:
    """Input files of each node. The tables hold no sources, so the files written below
    ``target`` stand for those of the same names below ``src``."""
    o = outputs(spark, sf).where(digests.normal_path("path") == F.col("path"))
    files = o.groupBy("path").agg(F.max("digest").alias("digest"))
    patterns = n.select("fqn", digests.directory("config_path").alias("base"), F.explode("cache.inputs").alias("p"))
    return records.input_files(patterns.select("fqn", "base", F.regexp_replace("p", "^src/", "target/").alias("pattern")), files)


_CLEAN = f"path is not null and path = {trim('path')} and not contains(path, '//') and not contains(path, '/./') and not contains(path, chr(92)) and not contains(path, '..') and not starts_with(path, '/') and not starts_with(path, './') and not ends_with(path, '/') and not ends_with(path, '/.')"
_OBJECT = "'{{' || array_to_string(list_transform({}, lambda x: to_json(x)::varchar || ':' || to_json({})::varchar), ',') || '}}'"


@query(
    V
    + f""", f as (select path, max(digest) as digest from outs where {_CLEAN} group by path),
p as (select distinct fqn, regexp_extract(config_path, '^(.*)/[^/]*$', 1) as base, regexp_replace(unnest(cache.inputs), '^src/', 'target/') as pattern from nodes),
m as (select p.fqn, substr(f.path, length(p.base) + 2) as name, f.digest from p join f on starts_with(f.path, p.base || '/' || replace(p.pattern, '**/*', ''))),
g as (select fqn, list(name order by string_split(name, '/')) as names, map_from_entries(list((name, digest))) as hashes from (select distinct * from m) group by fqn)
select n.fqn, '{{"environment":' || {_OBJECT.format("list_sort(list_distinct(coalesce(n.environment, [])))", "case x when 'LOG_LEVEL' then 'in' || chr(34) || 'fo' when 'REGION_CODE' then 'é' || chr(10) || '1' else '' end")}
  || ',"file_hashes":' || {_OBJECT.format("coalesce(g.names, [])", "g.hashes[x]")}
  || ',"run":' || to_json(coalesce(n.run, ''))::varchar || ',"tags":[' || array_to_string(list_transform(coalesce(n.tags, []), lambda x: to_json(x)::varchar), ',')
  || '],"variables":' || {_OBJECT.format("list_sort(map_keys(coalesce(n.variables, map {})))", "coalesce(n.variables[x], '')")} || '}}' as record
from nodes n left join g on n.fqn = g.fqn"""
)
def record_texts(spark, sf):
    """What a node's hash is over, in its canonical form."""
    n = nodes(spark, sf)
    return records.record_texts(n, record_files(spark, sf, n), VALUES)


@query()
def record_hash(spark, sf):
    n = nodes(spark, sf)
    return records.record_hashes(n, record_files(spark, sf, n), VALUES)


@query()
def merkle_fingerprint(spark, sf):
    n, e = edges(spark, sf)
    return graph.fingerprints(n.select("fqn").join(record_hash(spark, sf), "fqn"), e)


# -- selection --------------------------------------------------------------------------


@query(V + "select fqn from nodes where recipe = 'build'")
def select_exact(spark, sf):
    return selection.select_exact(nodes(spark, sf), ":build").select("fqn")


@query(V + "select fqn from nodes where regexp_matches(cookbook, '^(birch|onyx)-') and regexp_matches(recipe, 'e(-[0-9]+)?$')")
def select_regex(spark, sf):
    return selection.select_regex(nodes(spark, sf), "^(birch|onyx)-:e(-[0-9]+)?$").select("fqn")


@query(V + "select fqn from nodes where list_has_any(list_transform(tags, lambda x: lower(x)), ['backend', 'infra'])")
def select_tags(spark, sf):
    return selection.select_tags(nodes(spark, sf), ["Backend", "INFRA"]).select("fqn")


@query(V + "select fqn from nodes where coalesce(trim(run), '') = ''")
def blank_runs(spark, sf):
    return selection.blank_run(nodes(spark, sf)).select("fqn")


@query("select output_id from output_files where regexp_matches(path, '^libs/[^/]*/target/(.*/)?[^/]*\\.o$') group by output_id")
def glob_match(spark, sf):
    return table(spark, sf, "output_files").where(selection.matches_glob("path", ["libs/*/target/**/*.o"])).select("output_id").distinct()


@query(
    """with v as (select execution_id, columns('.*_version') as v, recorded_at from executions),
w as (select execution_id, v, row_number() over (partition by execution_id order by recorded_at desc) as rn from v),
p as (select execution_id, v, list_transform(list_filter(string_split(v, '.'), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: cast(x as bigint)) as parts from w where rn = 1)
select execution_id, v as version, parts > [1::bigint, 4, 1] as newer, regexp_matches(v, '-|alpha|beta|rc') as prerelease from p"""
)
def version_checks(spark, sf):
    e = table(spark, sf, "executions")
    rows = problems.latest(e.withColumnRenamed(version_column(e), "version"), "execution_id", "recorded_at", "version")
    return rows.select("execution_id", "version", versions.newer("version", F.lit("1.4.1")).alias("newer"), versions.prerelease("version").alias("prerelease"))


@query(V + "select digest from idx where floor((1460000000 - last_accessed) / 86400.0) >= 7 or last_accessed is null")
def throttle_due(spark, sf):
    return index(spark, sf).where(selection.due("last_accessed", F.lit(1_460_000_000), 7)).select("digest")


@query(V + "select distinct unnest(environment) as environment from nodes")
def environment_names(spark, sf):
    asmap = F.map_from_entries(F.transform(F.array_distinct("environment"), lambda x: F.struct(x, F.lit(1))))
    return selection.override_names(nodes(spark, sf).select(asmap.alias("overrides")))


@query(V + ", kv as (select fqn, unnest(map_entries(variables)) as e from nodes) select fqn, e.key as key, e.value as value from kv where e.value is not null")
def key_values(spark, sf):
    text = nodes(spark, sf).select("fqn", F.explode("variables")).select("fqn", F.concat_ws("=", "key", "value").alias("t")).where("t like '%=%'")
    return text.select("fqn", selection.key_value("t").alias("kv")).select("fqn", "kv.key", "kv.value")


@query(V + "select recipe, count(distinct cookbook) as cookbooks from nodes group by recipe having count(distinct cookbook) > 1")
def cross_namespace_names(spark, sf):
    per = nodes(spark, sf).groupBy("recipe").agg(F.countDistinct("cookbook").alias("cookbooks"))
    return per.where("cookbooks > 1")


@query(V + "select distinct recipe from nodes")
def distinct_names(spark, sf):
    return nodes(spark, sf).select("recipe").distinct().orderBy("recipe")


# -- store ---------------------------------------------------------------------------------


@query(V + "select key as digest, max(size) as size, count(*) as copies from blob_keys group by key")
def content_dedup(spark, sf):
    return store.dedup(problems.blob_rows(spark, sf).select(F.col("key").alias("digest"), "size"))


_STATS = """per as (select digest, count(*) as links, max(size) as size from outs group by digest),
st as (select count(*) as blobs, coalesce(sum(size), 0)::bigint as bytes, count(*) filter (links > 1) as shared_blobs,
  coalesce(sum(links) filter (links > 1), 0)::bigint as shared_links, sum(links)::bigint as refs from per)
"""


@query(V + "," + _STATS + "select * from st")
def storage_stats(spark, sf):
    return store.storage_stats(outputs(spark, sf))


@query(V + "," + _STATS + "select *, (refs - blobs) / refs::double as ratio, ((bytes // blobs) * (refs - blobs))::bigint as saved from st")
def dedup_ratio(spark, sf):
    return store.dedup_ratio(store.storage_stats(outputs(spark, sf)))


@query(V + "select sum((n - 1) * size)::bigint as saved from (select digest, count(*) as n, max(size) as size from outs group by digest)")
def link_savings(spark, sf):
    return store.link_savings(outputs(spark, sf))


@query(V + "select output_id, digest in (select digest from idx) as present from outs")
def contains_many(spark, sf):
    return store.contains_many(outputs(spark, sf), index(spark, sf)).select("output_id", "present")


@query(V + "select digest, max(size) as size from outs where digest not in (select digest from idx) group by digest")
def blobs_to_upload(spark, sf):
    return store.to_upload(outputs(spark, sf), index(spark, sf))


def _tiers(spark, sf):
    """Tier 0: often read blobs; 1: compressed ones; 2: all."""
    i = index(spark, sf)
    tier = F.explode(F.filter(F.array(F.when(F.col("access_count") > 3, 0), F.when(F.col("compression_format") == 1, 1), F.lit(2)), lambda x: x.isNotNull()))
    return i.select("digest", "size", tier.alias("tier"))


_TIERS = V + ", tiers as (select digest, size, 0 as tier from idx where access_count > 3 union all select digest, size, 1 from idx where compression_format = 1 union all select digest, size, 2 from idx)"


@query(_TIERS + ", w as (select distinct digest from outs) select w.digest, min(t.tier) as tier from w left join tiers t on w.digest = t.digest group by w.digest")
def tiered_lookup(spark, sf):
    return store.first_tier(outputs(spark, sf).select("digest").distinct(), _tiers(spark, sf))


@query(_TIERS + ", w as (select distinct digest from outs), f as (select w.digest, min(t.tier) as tier from w join tiers t on w.digest = t.digest group by w.digest) select f.digest, x.tier from f join (values (0), (1)) x(tier) on x.tier < f.tier")
def promotion_set(spark, sf):
    return store.promotions(tiered_lookup(spark, sf))


@query(
    _TIERS
    + """, need as (select distinct execution_id as batch, digest from outs where execution_id is not null), n as (select batch, count(*) as n from need group by batch),
h as (select batch, tier, count(*) as h from need join (select distinct tier, digest from tiers) t on need.digest = t.digest group by batch, tier)
select n.batch, min(h.tier) as tier from n left join h on n.batch = h.batch and n.n = h.h group by n.batch"""
)
def batch_get(spark, sf):
    wanted = outputs(spark, sf).where("execution_id is not null").select(F.col("execution_id").alias("batch"), "digest")
    return store.batch_get(wanted, _tiers(spark, sf))


@query(_TIERS + ", w as (select distinct digest from outs) select w.digest, min_by(t.size, t.tier) filter (t.size is not null) as size from w left join tiers t on w.digest = t.digest group by w.digest")
def size_lookup(spark, sf):
    return store.size_lookup(outputs(spark, sf).select("digest").distinct(), _tiers(spark, sf))


@query(V + "select digest from idx union select digest from outs")
def store_listing(spark, sf):
    return store.listing(index(spark, sf), outputs(spark, sf))


@query(V + "select count(*) as blobs, coalesce(sum(size), 0)::bigint as bytes, sum(size) / count(*)::double as average from idx")
def index_stats(spark, sf):
    return store.index_stats(index(spark, sf))


@query("select count(*) as manifests, coalesce(sum(octet_length(encode(extra))), 0)::bigint as bytes, coalesce(sum(octet_length(encode(extra))), 0)::bigint / count(*)::double as average from executions")
def manifest_stats(spark, sf):
    return store.manifest_stats(table(spark, sf, "executions"), F.octet_length("extra"))


@query(V + "select execution_id as action_key, coalesce(sum(size), 0)::bigint as output_bytes, count(*) as outputs from outs group by execution_id")
def output_sizes(spark, sf):
    return store.output_sizes(outputs(spark, sf).withColumnRenamed("execution_id", "action_key"))


@query(V + "select a.b as blob_bytes, m.b as manifest_bytes, (a.b + m.b)::bigint as bytes from (select sum(size)::bigint as b from idx) a, (select sum(octet_length(encode(extra)))::bigint as b from executions) m")
def cached_bytes(spark, sf):
    return store.cached_bytes(index(spark, sf), table(spark, sf, "executions"), F.octet_length("extra"))


@query(V + "select digest, last_accessed from idx order by last_accessed, stored_at, digest limit 100 offset 20")
def lru_candidates(spark, sf):
    return store.lru(index(spark, sf), 100, 20).select("digest", "last_accessed")


@query(V + "select digest, size from idx order by size desc nulls last, digest limit 100")
def largest_blobs(spark, sf):
    return store.largest(index(spark, sf), 100).select("digest", "size")


@query(
    V
    + """, c as (select *, coalesce(sum(coalesce(size, 0)) over (order by last_accessed nulls first, stored_at, digest rows between unbounded preceding and 1 preceding), 0) as before, sum(size) over () as total from idx)
select digest, size from c where before < total - 100000000"""
)
def evict_to_size(spark, sf):
    return store.evict_to_size(index(spark, sf), 100_000_000).select("digest", "size")


@query(V + ", e as (select size from idx order by last_accessed, stored_at, digest limit 500) select count(*) as blobs, coalesce(sum(size), 0)::bigint as bytes from e")
def evict_lru_freed(spark, sf):
    return store.freed(store.lru(index(spark, sf), 500))


@query(V + ", e as (select size from idx order by size desc nulls last, digest limit 500) select count(*) as blobs, coalesce(sum(size), 0)::bigint as bytes from e")
def evict_largest_freed(spark, sf):
    return store.freed(store.largest(index(spark, sf), 500))


@query(V + "select digest, algorithm, size, stored_at, access_count, last_accessed, compression_format from idx")
def index_upsert(spark, sf):
    """All puts into an empty index: the latest of each digest stays."""
    rows = problems.blob_rows(spark, sf).select(
        F.col("key").alias("digest"), F.substring_index("key", ":", 1).alias("algorithm"), "size", "stored_at", "access_count", "last_accessed", "compression_format", "blob_id"
    )
    empty = rows.where(F.lit(False))
    return store.upsert(empty, rows, "blob_id").drop("blob_id")


@query(
    V
    + """, a as (select digest, count(*) as n, max(epoch_us(f.written_at) // 1000000) as at from outs o join (select output_id, max(written_at) as written_at from output_files group by output_id) f using (output_id) group by digest)
select i.digest, i.access_count + coalesce(a.n, 0) as access_count, greatest(i.last_accessed, a.at) as last_accessed from idx i left join a on i.digest = a.digest"""
)
def index_touch(spark, sf):
    at = table(spark, sf, "output_files").groupBy("output_id").agg(F.unix_seconds(F.max("written_at").cast("timestamp")).alias("at"))
    return store.touch(index(spark, sf), outputs(spark, sf).join(at, "output_id").select("digest", "at")).select("digest", "access_count", "last_accessed")


@query(V + "select digest from idx where digest not in (select digest from outs)")
def unreferenced_blobs(spark, sf):
    return store.delete(index(spark, sf), outputs(spark, sf)).select("digest")


_FILES = "files as (select path, size from outs where is_executable)"


@query(V + f", {_FILES}, t as (select path, max(size) as there from files group by path) select output_id from outs o left join t on o.path = t.path where t.there is null or t.there is distinct from o.size")
def restore_needed(spark, sf):
    o = outputs(spark, sf)
    return selection.needs_restore(o, o.where("is_executable")).select("output_id")


@query(
    V
    + f""", {_FILES}, t as (select path, max(size) as there from files group by path),
k as (select o.execution_id::varchar as action_key, bool_and(not (t.there is null or t.there is distinct from o.size) or o.digest in (select digest from idx)) as ok
  from outs o left join t on o.path = t.path where o.execution_id is not null group by 1)
select distinct e.execution_id::varchar as action_key, case when k.ok then 'hit' else 'miss' end as result from executions e left join k on e.execution_id::varchar = k.action_key where e.execution_id is not null"""
)
def cache_results(spark, sf):
    o = outputs(spark, sf).where("execution_id is not null").withColumn("action_key", F.col("execution_id").cast("string"))
    actions = table(spark, sf, "executions").where("execution_id is not null").select(F.col("execution_id").cast("string").alias("action_key"))
    return store.cache_results(actions, o, index(spark, sf), o.where("is_executable"))


@query(
    """with l as (select action_key, max(recipe) as m from executions where exit_code = 0 group by 1), r as (select action_key, max(recipe) as m from executions group by 1)
select k.action_key, coalesce(l.m, r.m) as manifest, l.m is null and r.m is not null as backfill from (select distinct action_key from executions where action_key is not null) k left join l using (action_key) left join r using (action_key)"""
)
def manifest_lookup(spark, sf):
    """Local: successful results; remote: all."""
    e = table(spark, sf, "executions").where("action_key is not null").withColumn("manifest", F.col("recipe"))
    return store.manifest_lookup(e.select("action_key").distinct(), store.succeeded(e), e).select("action_key", "manifest", "backfill")


@query("with e as (select * from (select *, row_number() over (partition by execution_id order by recorded_at desc) as rn from executions) where rn = 1) select recipe as fqn, count(*) as runs, sum(case when completed_at < started_at then 0 else epoch_us(completed_at) - epoch_us(started_at) end)::bigint as duration_us from e group by recipe")
def run_durations(spark, sf):
    e = problems.latest(table(spark, sf, "executions"), "execution_id", "recorded_at", "recipe", "started_at", "completed_at")
    return store.durations(e).groupBy(F.col("recipe").alias("fqn")).agg(F.count("*").alias("runs"), F.sum("duration_us").alias("duration_us"))


@query("with e as (select * from (select *, row_number() over (partition by execution_id order by recorded_at desc) as rn from executions) where rn = 1) select recipe as fqn, concat_ws(': ', recipe, 'exit code ' || exit_code) as line from e where exit_code <> 0")
def failure_report(spark, sf):
    e = problems.latest(table(spark, sf, "executions"), "execution_id", "recorded_at", "recipe", "exit_code")
    return store.failure_report(e.withColumn("message", F.concat(F.lit("exit code "), F.col("exit_code").cast("string"))))


# -- overlays -------------------------------------------------------------------------------


def _first_of_cookbook(n: DataFrame) -> DataFrame:
    """Each cookbook's least recipe stands for the cookbook's own settings."""
    return n.groupBy("cookbook").agg(F.min_by(F.struct("variables", "environment", "tags"), "fqn").alias("b")).select("cookbook", "b.*")


_BOOK = V + ", book as (select cookbook, min_by(variables, fqn) as bv, min_by(environment, fqn) as be, min_by(tags, fqn) as bt from (select *, 1 as one from nodes) group by cookbook)"


@query(
    _BOOK
    + """, s as (
  select fqn, 0 as rank, 'mode' as key, 'base' as value from nodes
  union all select n.fqn, 2, e.key, e.value from (select n.fqn, unnest(map_entries(b.bv)) as e from nodes n join book b on n.cookbook = b.cookbook) n
  union all select n.fqn, 4, e.key, e.value from (select fqn, unnest(map_entries(variables)) as e from nodes) n
  union all select fqn, 6, 'level', '1' from nodes)
select fqn, key, value, rank from (select *, row_number() over (partition by fqn, key order by rank desc) as rn from s) where rn = 1"""
)
def overlay_effective(spark, sf):
    n = nodes(spark, sf)
    books = n.select("fqn", "cookbook").join(_first_of_cookbook(n).select("cookbook", "variables"), "cookbook")
    project = n.select("fqn", F.create_map(F.lit("mode"), F.lit("base")).alias("variables"))
    rows = overlay.scope_rows(project, "fqn", "variables", "project").unionByName(overlay.scope_rows(books, "fqn", "variables", "cookbook"))
    rows = rows.unionByName(overlay.scope_rows(n, "fqn", "variables", "recipe")).unionByName(overlay.command_rows(n, {"level": "1"}))
    return overlay.effective(rows)


@query(_BOOK + "select n.fqn, array_to_string(list_concat(['CI'], list_concat(coalesce(b.be, []), coalesce(n.environment, []))), ',') as environment from nodes n join book b on n.cookbook = b.cookbook")
def env_inheritance(spark, sf):
    n = nodes(spark, sf)
    joined = n.alias("n").join(_first_of_cookbook(n).alias("b"), "cookbook")
    env = overlay.inherited_environment(F.array(F.lit("CI")), F.col("b.environment"), F.col("n.environment"))
    return joined.select("n.fqn", F.array_join(env, ",").alias("environment"))


@query(_BOOK + "select n.fqn, array_to_string(case when len(coalesce(n.tags, [])) = 0 then b.bt else n.tags end, ',') as tags from nodes n join book b on n.cookbook = b.cookbook")
def tag_inheritance(spark, sf):
    n = nodes(spark, sf)
    joined = n.alias("n").join(_first_of_cookbook(n).alias("b"), "cookbook")
    return joined.select("n.fqn", F.array_join(overlay.inherited_tags(F.col("n.tags"), F.col("b.tags")), ",").alias("tags"))


def _uses(spark, sf) -> tuple[DataFrame, DataFrame]:
    n = nodes(spark, sf).where("template is not null")
    given = n.select("fqn", F.explode(F.from_json("parameters", "map<string,string>")).alias("param", "value"))
    return n.select("fqn", digests.trimmed("template").alias("template")), given


@query(
    V
    + f""", d as (select name as template, k as param, lower(coalesce(parameters->k->>'type', 'string')) as type, coalesce((parameters->k->>'required')::boolean, false) as required, parameters->k->>'default' as def
  from (select name, parameters::json as parameters, unnest(json_keys(parameters::json)) as k from temps where parameters is not null)),
u as (select fqn, {trim('template')} as template from nodes where template is not null),
g as (select fqn, k as param, p->>k as value from (select fqn, parameters::json as p, unnest(json_keys(parameters::json)) as k from nodes where template is not null and parameters is not null)),
w as (select u.fqn, d.param, d.type, d.required, d.def from u join d on u.template = d.template),
j as (select coalesce(w.fqn, g.fqn) as fqn, coalesce(w.param, g.param) as param, case when g.fqn is not null then g.value else w.def end as value, w.type, w.required from w full join g on w.fqn = g.fqn and w.param = g.param),
c as (select fqn, param, value, case when type is null then null when value is null and required then 'missing'
  when value is not null and type <> (case when try_cast(value as double) is not null then 'number' when value in ('true', 'false') then 'boolean' else 'string' end) then 'type' end as error from j)
select * from c where value is not null or error is not null"""
)
def param_validation(spark, sf):
    return overlay.resolve_parameters(*_uses(spark, sf), overlay.declared(templates(spark, sf)))


@query(V + f"select fqn, {trim('template')} as template from nodes where template is not null and {trim('template')} not in (select name from temps)")
def unknown_template(spark, sf):
    return overlay.unknown_templates(_uses(spark, sf)[0], templates(spark, sf)).select("fqn", "template")


@query(
    V
    + f"""select n.fqn, coalesce(n.description, t.description) as description, case when coalesce(n.run, '') <> '' then n.run else t.template_content end as run
from nodes n join temps t on {trim('n.template')} = t.name"""
)
def template_merge(spark, sf):
    none, text = F.lit(None).cast("array<string>"), F.lit(None).cast("map<string,string>")
    t = templates(spark, sf).select("name", F.struct("description", none.alias("dependencies"), F.lit(None).cast("struct<inputs:array<string>,outputs:array<string>>").alias("cache"), F.col("template_content").alias("run"), none.alias("environment"), text.alias("variables"), none.alias("tags")).alias("t"))
    n = nodes(spark, sf).withColumn("n", F.struct("description", "dependencies", "cache", "run", "environment", "variables"))
    joined = n.join(t, digests.trimmed("template") == t["name"])
    merged = overlay.merge_template("n", "t")
    return joined.select("fqn", merged["description"].alias("description"), merged["run"].alias("run"))


@query(V + "select name, replace(template_content, '{{ params.jobs }}', coalesce(parameters::json->'jobs'->>'default', '')) as text from temps")
def template_render(spark, sf):
    defaults = overlay.declared(templates(spark, sf)).where(F.col("default").isNotNull())
    params = defaults.groupBy(F.col("template").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("param", "default"))).alias("p"))
    t = templates(spark, sf).join(params, "name", "left")
    context = F.to_json(F.struct(F.col("p").alias("params")))
    return t.select("name", render.render_column("template_content", context).alias("text"))


# -- bytes and names ----------------------------------------------------------------------------


@query(V + "select substr(split_part(digest, ':', 2), 1, 2) as shard, count(*) as blobs from idx group by 1")
def shard_histogram(spark, sf):
    return index(spark, sf).groupBy(digests.shard(F.substring_index("digest", ":", -1)).alias("shard")).agg(F.count("*").alias("blobs"))


@query(V + "select digest, 'cas/' || algorithm || '/' || substr(split_part(digest, ':', 2), 1, 2) || '/' || split_part(digest, ':', 2) as path from idx")
def blob_paths(spark, sf):
    parsed = index(spark, sf).withColumn("d", digests.parse_digest("digest"))
    return parsed.select("digest", digests.blob_path("d.algorithm", "d.hex", "cas").alias("path"))


@query("select distinct action_key, lower(hex(encode(action_key))) || '.json' as name, action_key as back from executions where action_key is not null")
def manifest_names(spark, sf):
    e = table(spark, sf, "executions").where("action_key is not null").select("action_key").distinct().withColumn("name", digests.manifest_name("action_key"))
    return e.withColumn("back", digests.manifest_key("name"))


@query(V + "select fqn, replace(fqn, ':', '.') || '.log' as log from nodes")
def log_names(spark, sf):
    from ..sources.files import log_name

    return nodes(spark, sf).select("fqn", log_name("fqn").alias("log"))


@query(V + "select digest, (h like '1f8b%' or h like '28b52ffd%' or h like '425a68%' or h like 'fd377a58%' or h like '504b0304%' or h like '377abcaf%' or h like '89504e47%' or h like 'ffd8ff%' or h like '1a45dfa3%' or substr(h, 17, 8) = '57454250' or substr(h, 9, 8) = '66747970') as compressed from (select digest, split_part(digest, ':', 2) as h from idx)")
def compressed_sniff(spark, sf):
    """The digests' own bytes stand for contents."""
    return index(spark, sf).select("digest", codec.compressed(F.unhex(F.substring_index("digest", ":", -1))).alias("compressed"))


SECRET = b"a secret of the tests, longer than one block of the hash so that it is hashed first"
_PADS = signing.hashlib.sha256(SECRET).digest().ljust(64, b"\0")


@query(
    "select distinct action_key, sha256(unhex('" + bytes(b ^ 0x5C for b in _PADS).hex() + "') || unhex(sha256(unhex('" + bytes(b ^ 0x36 for b in _PADS).hex() + "') || encode(action_key)))) as signature from executions where action_key is not null"
)
def hmac_sign(spark, sf):
    keys = table(spark, sf, "executions").where("action_key is not null").select("action_key").distinct()
    return keys.withColumn("signature", signing.hmac_sha256("action_key", SECRET))


@query()
def fastcdc_chunks(spark, sf):
    return chunking.chunks(table(spark, sf, "documents"), "doc_id", "text", 64, 256, 1024)


@query()
def chunk_stats(spark, sf):
    return chunking.chunk_stats(fastcdc_chunks(spark, sf), "doc_id")


@query()
def blake3_digests(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", blake3.blake3(F.encode("text", "UTF-8")).alias("digest"))


@query("select doc_id, true as same from documents where text is not null")
def compress_round_trip(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return docs.select("doc_id", (codec.unpack(codec.pack("data")) == F.col("data")).alias("same"))


@query(V + f"select distinct path, key as digest from file_keys where path is not null and not contains(replace({trim('path')}, chr(92), '/'), '..') and path = {trim('path')} and not contains(path, '//') and not contains(path, '/./') and not contains(path, chr(92)) and not contains(path, '..') and not starts_with(path, '/') and not starts_with(path, './') and not ends_with(path, '/') and not ends_with(path, '/.')")
def clean_paths(spark, sf):
    """Paths that are in normal form as they stand."""
    rows = table(spark, sf, "output_files").where("path is not null").select("path", digests.digest_key("digest").alias("digest"))
    return rows.where(digests.normal_path("path") == F.col("path")).distinct()
