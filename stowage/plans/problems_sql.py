"""The problems' queries as ANSI SQL over the same tables."""

_TRIM = "trim({}, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11))"


def trim(x: str) -> str:
    return _TRIM.format(x)


#: Shared views: named recipe loads, references, digest keys, normal paths.
VIEWS = f"""
loads as (
  select coalesce(nullif({trim('fqn')}, ''), {trim('cookbook')} || ':' || {trim('recipe')}) as name, * from recipes
),
named as (select * from loads where name is not null),
current_recipe as (
  select * from (select *, row_number() over (partition by name order by recipe_id desc) as rn from named) where rn = 1
),
raw_refs as (select name, recipe_id, loaded_at, {trim('d')} as d from (select name, recipe_id, loaded_at, unnest(dependencies) as d from current_recipe)),
refs as (
  select distinct name, recipe_id, loaded_at,
    case when contains(d, ':') then d else split_part(name, ':', 1) || ':' || d end as ref
  from raw_refs where d is not null and d <> ''
),
blob_keys as (
  select *, case when contains(lower({trim('digest')}), ':') then lower({trim('digest')})
    else coalesce(nullif(lower({trim('algorithm')}), ''), 'blake3') || ':' || lower({trim('digest')}) end as key from blobs
),
file_keys as (
  select *, case when contains({trim('digest')}, ':') then lower({trim('digest')}) else 'blake3:' || lower({trim('digest')}) end as key,
    lower({trim('digest')}) as low from output_files
)
"""

_FOREST = f"""
with recursive {VIEWS},
temps as (select {trim('name')} as name, template_id, {trim('extends')} as up from recipe_templates where {trim('name')} <> ''),
nodes as (
  select 'recipe' as forest, name as n from named union select 'recipe', {trim('fqn')} from graph_nodes where {trim('fqn')} <> ''
  union select 'template', name from temps
),
all_links as (
  select 'recipe' as forest, name as src, ref as dst from refs
  union select 'template', name, up from (select *, row_number() over (partition by name order by template_id desc) as rn from temps) where rn = 1
),
links as (select l.* from all_links l join nodes d on l.forest = d.forest and l.dst = d.n),
reach(forest, src, dst) as (select forest, src, dst from links union select r.forest, r.src, l.dst from reach r join links l on r.forest = l.forest and r.dst = l.src)
"""

P1_DESCENDANTS = _FOREST + "select forest, dst as node, src as descendant from reach"

P1_FOUND = (
    _FOREST
    + """,
ring as (select forest, src as n from reach where src = dst),
bad as (select r.forest, r.src as n, min(r.dst) as least from reach r join ring g on r.forest = g.forest and r.dst = g.n group by r.forest, r.src),
good as (select * from nodes where (forest, n) not in (select forest, n from bad)),
ways(forest, node, root, depth) as (
  select forest, n, n, 0 from good where (forest, n) not in (select forest, src from links)
  union select w.forest, l.src, w.root, w.depth + 1 from ways w join links l on w.forest = l.forest and w.node = l.dst
    join good g on g.forest = l.forest and g.n = l.src
)
select forest, node, root, cast(max(depth) as bigint) as depth from ways group by forest, node, root
union all
select b.forest, b.n, b.least, case when r.n is null then -2 else -1 end from bad b left join ring r on b.forest = r.forest and b.n = r.n
"""
)

#: From the node towards the root, always to the least name that the longest way allows.
P1_PATHS = (
    P1_FOUND.split("select forest, node, root, cast(max(depth)")[0]
    + """,
far as (select forest, node, root, max(depth) as depth from ways group by forest, node, root),
step as (
  select a.forest, a.node, a.root, min(l.dst) as up from far a join links l on a.forest = l.forest and a.node = l.src
  join far b on b.forest = a.forest and b.node = l.dst and b.root = a.root and b.depth = a.depth - 1 group by 1, 2, 3
),
walk(forest, node, root, depth, here, way, turn) as (
  select forest, node, root, depth, node, node, 0 from far
  union all
  select w.forest, w.node, w.root, w.depth, s.up, s.up || ' > ' || w.way, w.turn + 1 from walk w
  join step s on s.forest = w.forest and s.node = w.here and s.root = w.root where w.turn < w.depth
)
select forest, node, root, cast(depth as bigint) as depth, way from walk where turn = depth
"""
)

P2_FOUND = f"""
with {VIEWS},
lives as (
  select n.name, min(n.loaded_at) as since, max(c.removed_at) as until from named n join current_recipe c on n.name = c.name group by n.name
),
a as (
  select 'recipes' as source_table, r.recipe_id as source_id, r.ref,
    case when l.name is null then 'missing' when r.loaded_at < l.since then 'late' when l.until is null or r.loaded_at < l.until then null else 'deleted' end as reason,
    strftime(r.loaded_at, '%Y-%m-%d') as period
  from refs r left join lives l on r.ref = l.name
),
f as (
  select distinct output_id, case when regexp_full_match(key, '(blake3|sha256):[0-9a-f]{{64}}') then key else low end as ref,
    cast(floor(epoch_us(written_at) / 1000000.0) as bigint) as t, strftime(written_at, '%Y-%m-%d') as period
  from file_keys where digest is not null
),
b as (
  select 'output_files' as source_table, f.output_id as source_id, f.ref,
    case when count(k.key) = 0 then 'missing' when min(k.stored_at) > f.t then 'late'
      when bool_or(k.stored_at <= f.t and (k.removed_at is null or k.removed_at > f.t)) then null else 'deleted' end as reason,
    f.period
  from f left join blob_keys k on f.ref = k.key group by f.output_id, f.ref, f.t, f.period
)
select source_table, source_id, ref, reason, period from (select * from a union all select * from b) where reason is not null
"""

P2_COUNTS = f"""
select source_table, period, reason, count(*) as orphans, count(distinct ref) as targets from ({P2_FOUND}) group by source_table, period, reason
"""

#: ``..`` is resolved by removing one ``segment/..`` at a time.
_P4_SMALL = f"""
with recursive {VIEWS},
walk(raw, p, turn) as (
  select distinct path, '/' || array_to_string(list_filter(string_split(replace({trim('path')}, chr(92), '/'), '/'), lambda x: x <> '' and x <> '.'), '/') || '/', 0
  from output_files where path is not null
  union all
  select raw, case when p like '/../%' then substr(p, 4) else regexp_replace(p, '/[^/]+/\\.\\./', '/') end, turn + 1 from walk where p like '%/../%'
),
clean as (select raw, trim(max_by(p, turn), '/') as path from walk group by raw),
files as (
  select c.path, f.key, row_number() over (partition by c.path order by f.written_at desc nulls last, f.output_id desc) as rn
  from file_keys f join clean c on f.path = c.raw where f.digest is not null and c.path <> ''
),
sizes as (select key, max(size) as size from blob_keys group by key),
small as (
  select f.path, f.key as digest, s.size, regexp_extract(f.path, '^(.*)/[^/]*$', 1) as dir from files f join sizes s on f.key = s.key where f.rn = 1 and s.size < 65536
),
crowded as (select * from small where dir in (select dir from small group by dir having count(*) >= 20))
"""

P4_FOUND = _P4_SMALL + "select path, digest from crowded"

#: One lane per directory, as long as none holds more files than a lane.
P4_PLAN = (
    _P4_SMALL
    + """, b as (select *, coalesce(sum(size) over (partition by dir order by path rows between unbounded preceding and 1 preceding), 0)::bigint as before from crowded)
select dir || '#0#' || (before // 33554432) as container, (before - min(before) over (partition by dir, before // 33554432))::bigint as "offset", size as length, path, digest from b
"""
)

P4_CONTAINERS = f'select count(distinct container) as containers, count(*) as files, sum(length)::bigint as bytes from ({P4_PLAN})'

P4_ARCHIVE = """
select concat_ws('/', source, cast(doc_id as varchar)) as path, cast(octet_length(encode(text)) as bigint) as length, sha256(text) as checksum, true as ok
from documents where text is not null
"""

P5_FOUND = f"""
with one as (
  select execution_id, hostname, started_at, completed_at,
    row_number() over (partition by execution_id order by recorded_at desc nulls last) as rn from executions where execution_id is not null
),
iv as (
  select distinct nullif(nullif(split_part(lower({trim('hostname')}), '.', 1), ''), 'unknown') as h, epoch_us(started_at) as s, epoch_us(completed_at) as t
  from one where rn = 1 and completed_at > started_at
),
marked as (
  select h, s, t, max(t) over (partition by h order by s, t rows between unbounded preceding and 1 preceding) as reach from iv where h is not null
),
grouped as (select h, s, t, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by h order by s, t rows unbounded preceding) as g from marked),
busy as (select h, min(s) as s, max(t) as t from grouped group by h, g),
gaps as (select h, t as s, lead(s) over (partition by h order by s) as t from busy)
select h as hostname, 'busy' as kind, s as start_us, t as end_us from busy
union all
select h, 'gap', s, t from gaps where t is not null and t - s <= 259200000000
"""

SQL = {"p1_found": P1_FOUND, "p1_paths": P1_PATHS, "p1_descendants": P1_DESCENDANTS, "p4_plan": P4_PLAN, "p4_containers": P4_CONTAINERS, "p2_found": P2_FOUND, "p2_counts": P2_COUNTS, "p4_found": P4_FOUND, "p4_archive": P4_ARCHIVE, "p5_found": P5_FOUND}
