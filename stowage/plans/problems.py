"""The general training-data problems over this project's tables (p1, p2, p4, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, times
from ..operators import compaction, hierarchy, intervals, orphans
from ..session import cut, remove_folder, shared_folder, table

#: Nodes of a fragment of problem 1 where more only serve more tasks.
LEAST_NODES = 200
MAX_GAP_US = 72 * 3_600_000_000


# -- records -----------------------------------------------------------------


def recipe_loads(spark: SparkSession, sf: str) -> DataFrame:
    """All loads with a clean ``name`` (FQN)."""
    r = table(spark, sf, "recipes")
    own = F.concat(digests.trimmed("cookbook"), F.lit(":"), digests.trimmed("recipe"))
    given = digests.trimmed("fqn")
    return r.withColumn("name", F.when(given != "", given).otherwise(own)).where(F.col("name").isNotNull())


def latest(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Per key the ``values`` of the row with the greatest ``order``."""
    return df.groupBy(key).agg(F.max_by(F.struct(order, *values), F.col(order)).alias("_x")).select(key, "_x.*")


def references(loads: DataFrame, *keep: str) -> DataFrame:
    """One row per distinct reference of a recipe row: trimmed, blanks dropped,
    qualified with the own cookbook."""
    own = F.substring_index("name", ":", 1)
    clean = F.filter(F.transform("dependencies", digests.trimmed), lambda x: x.isNotNull() & (x != ""))
    full = F.transform(clean, lambda x: F.when(F.contains(x, F.lit(":")), x).otherwise(F.concat(own, F.lit(":"), x)))
    return loads.select(*keep, F.explode(F.array_distinct(full)).alias("ref"))


def blob_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "blobs").withColumn("key", digests.digest_key("digest", "algorithm"))


# -- p1 ----------------------------------------------------------------------


def forest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, place) and links (src, dst) of both forests; names carry the
    forest's first letter and a bar."""
    loads = recipe_loads(spark, sf)
    current = latest(loads, "name", "recipe_id", "dependencies")
    registered = table(spark, sf, "graph_nodes").select(digests.trimmed("fqn").alias("name"), F.col("node_index").alias("place")).where("name <> ''")
    known = loads.select("name", F.col("recipe_id").alias("place")).unionByName(registered)
    links = references(current, "name").select(F.col("name").alias("src"), F.col("ref").alias("dst"))
    t = table(spark, sf, "recipe_templates").withColumn("name", digests.trimmed("name")).where("name <> ''")
    parents = latest(t, "name", "template_id", "extends").select(F.col("name").alias("src"), digests.trimmed("extends").alias("dst")).where("dst <> ''")
    templates = t.select("name", F.col("template_id").alias("place"))
    mark = lambda df, letter, *cols: df.withColumns({c: F.concat(F.lit(letter + "|"), F.col(c)) for c in cols})
    nodes = mark(known, "r", "name").unionByName(mark(templates, "t", "name"))
    return nodes, mark(links, "r", "src", "dst").unionByName(mark(parents, "t", "src", "dst"))


def _unmark(df: DataFrame, *cols: str) -> DataFrame:
    kind = F.when(F.startswith("node", F.lit("r|")), F.lit("recipe")).otherwise(F.lit("template"))
    return df.withColumn("forest", kind).withColumns({c: F.substring(F.col(c), F.lit(3), F.length(c)) for c in cols})


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    out = hierarchy.hierarchies(*forest(spark, sf), paths=False, least_nodes=LEAST_NODES)
    return _unmark(out, "node", "root").select("forest", "node", "root", "depth")


def p1_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The longest way from each root down to each node, as text; of ways as long the
    least, name by name from the node on."""
    out = hierarchy.hierarchies(*forest(spark, sf), least_nodes=LEAST_NODES).where("depth >= 0")
    down = F.concat(F.reverse(F.transform("path", lambda x: F.substring(x, F.lit(3), F.length(x)))), F.array(F.substring("node", 3, 1 << 20)))
    return _unmark(out.withColumn("way", F.array_join(down, " > ")), "node", "root").select("forest", "node", "root", "depth", "way")


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All descendants of every node: the nodes whose links lead to it."""
    out = hierarchy.descendants(*forest(spark, sf), least_nodes=LEAST_NODES)
    return _unmark(out, "node", "descendant").select("forest", "node", "descendant")


# -- p2 ----------------------------------------------------------------------


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    loads = recipe_loads(spark, sf)
    current = latest(loads, "name", "recipe_id", "dependencies", "loaded_at", "removed_at")
    # recipes live from their earliest load until the removal of the current row
    lives = loads.groupBy("name").agg(F.min(times.micros("loaded_at")).alias("since"), F.max_by(F.struct("removed_at"), F.col("recipe_id")).alias("c"))
    lives = lives.select(F.col("name").alias("key"), "since", times.micros("c.removed_at").alias("until"))
    asked = references(current, "name", "recipe_id", "loaded_at").select(F.col("recipe_id").alias("source_id"), "ref", times.micros("loaded_at").alias("at"), F.to_date("loaded_at").cast("string").alias("period"))
    a = orphans.find_orphans(asked, lives, ["source_id", "period"]).withColumn("source_table", F.lit("recipes"))

    blobs = blob_rows(spark, sf).select("key", F.col("stored_at").alias("since"), F.col("removed_at").alias("until"))
    key = digests.digest_key("digest")
    files = (
        table(spark, sf, "output_files")
        .where(F.col("digest").isNotNull())
        .select(
            F.col("output_id").alias("source_id"),
            F.when(digests.is_well_formed(key), key).otherwise(F.lower(digests.trimmed("digest"))).alias("ref"),
            times.seconds("written_at").alias("at"),
            F.to_date("written_at").cast("string").alias("period"),
        )
    )
    b = orphans.find_orphans(files, blobs, ["source_id", "period"]).withColumn("source_table", F.lit("output_files"))
    return a.unionByName(b).select("source_table", "source_id", "ref", "reason", "period")


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_counts(p2_found(spark, sf))


# -- p4 ----------------------------------------------------------------------


def current_files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, digest key, directory, size) of the current row of each path."""
    rows = (
        table(spark, sf, "output_files")
        .where(F.col("digest").isNotNull() & F.col("path").isNotNull())
        .select(digests.normal_path("path").alias("path"), digests.digest_key("digest").alias("digest"), "written_at", "output_id")
        .where(F.col("path").isNotNull())
    )
    now = rows.groupBy("path").agg(F.max(F.struct("written_at", "output_id", "digest")).alias("x")).select("path", F.col("x.digest").alias("digest"))
    sizes = blob_rows(spark, sf).groupBy("key").agg(F.max("size").alias("size"))
    return now.join(sizes, now["digest"] == sizes["key"]).select("path", "digest", "size", digests.directory("path").alias("directory"))


def p4_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Where each small file of a crowded directory goes; containers fill across directories."""
    small = cut(compaction.crowded_small_files(current_files(spark, sf)))
    return compaction.container_plan(small).select("container", "offset", "length", "path", "digest")


def p4_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The plan of one directory at a time, as its SQL defines it."""
    small = compaction.crowded_small_files(current_files(spark, sf))
    return compaction.group_plan(small).select("container", "offset", "length", "path", "digest")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """What the indexes of the planned containers list."""
    index = compaction.planned_index(p4_packed(spark, sf), "digest")
    return index.select(F.explode("index").alias("e")).select("e.path", "e.digest")


def p4_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = compaction.container_sizes(p4_plan(spark, sf))
    return sizes.agg(F.count("*").alias("containers"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def p4_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the bytes of every text into an archive and reads them back by its index."""
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull())
    files = docs.select(F.coalesce("source", F.lit("")).alias("directory"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    root = shared_folder(spark, "archive")
    compaction.write_archive(files, root)
    back = compaction.read_archive(compaction.archive_index(spark, root), root)
    out = cut(back.select("path", F.octet_length("content").cast("bigint").alias("length"), F.sha2("content", 256).alias("checksum"), "ok"))
    remove_folder(spark, root)
    return out


# -- p5 ----------------------------------------------------------------------


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "executions").where(F.col("execution_id").isNotNull())
    # rows of one id that share the greatest recorded_at: the greatest values win
    x = F.struct("recorded_at", digests.host("hostname").alias("hostname"), times.micros("started_at").alias("s"), times.micros("completed_at").alias("t"))
    one = rows.groupBy("execution_id").agg(F.max(x).alias("x")).select("x.hostname", "x.s", "x.t")
    return intervals.periods_and_gaps(one, "hostname", "s", "t", MAX_GAP_US)
