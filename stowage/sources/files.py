"""Blobs, manifests, file scans and logs on any Hadoop file system."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blake3, digests
from ..operators.selection import matches_glob
from . import walk

MANIFEST = (
    "action_key string, recipe string, exit_code int, outputs array<struct<path:string,digest:string,size:bigint,is_executable:boolean,"
    "node_properties:struct<type:string,target:string,description:string>>>, stdout_digest string, stderr_digest string, "
    "execution_metadata struct<started_at:timestamp,completed_at:timestamp,hostname:string,version:string,extra:string>"
)


def read_files(spark: SparkSession, root: str, base: str | None = None, patterns: list[str] | None = None, contents: bool = True, **options) -> DataFrame:
    """(path, size, content) of every file below ``root``, whatever its name begins
    with, with paths relative to ``base``; with ``patterns`` only the files that match
    one are read. ``options``: those of :func:`walk.list_files` (ignore files)."""
    prefix = walk.absolute(base or root).rstrip("/") + "/"
    full = F.col("path")
    inside = F.when(F.startswith(full, F.lit(prefix)), F.substring(full, F.lit(len(prefix) + 1), F.length(full))).otherwise(full)
    files = walk.list_files(spark, root, **options).withColumn("name", inside)
    if patterns is not None:
        files = files.where(matches_glob("name", patterns))
    if contents:
        files = walk.with_contents(files)
    return files.drop("path").withColumnRenamed("name", "path").select("path", "size", *(["content"] if contents else []))


def hashed_files(spark: SparkSession, root: str, patterns: list[str], base: str | None = None, **options) -> DataFrame:
    """(path, size, digest): BLAKE3 of the files that match a pattern; only those are read."""
    return read_files(spark, root, base, patterns, **options).select("path", "size", blake3.blake3("content").alias("digest"))


def expand_outputs(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files that are an output (path) or lie below one; missing outputs give none."""
    ways = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.call_function("substring_index", F.col("path"), F.lit("/"), i))
    below = files.withColumn("output", F.explode(ways))
    return below.join(outputs.select(F.col("path").alias("output")).distinct(), "output", "left_semi").drop("output").dropDuplicates(["path"])


def write_manifests(manifests: DataFrame, path: str) -> None:
    """One JSON line per manifest, keyed by its file name."""
    manifests.withColumn("name", digests.manifest_name("action_key")).write.mode("append").json(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests; keys come from the names, other names are skipped."""
    rows = spark.read.schema(MANIFEST + ", name string").json(path)
    return rows.withColumn("action_key", F.coalesce(digests.manifest_key("name"), "action_key")).where(F.col("action_key").isNotNull()).drop("name")


def write_manifest_files(manifests: DataFrame, root: str) -> int:
    """One file per action key, ``<hex of the key>.json``; a later write replaces it."""
    path = F.concat(F.lit(root.rstrip("/") + "/"), digests.manifest_name("action_key"))
    return walk.write_files(manifests.where("action_key is not null").select(path.alias("path"), F.encode(manifest_json(), "UTF-8").alias("content")))


def read_manifest_files(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of a folder of ``<hex>.json`` files; other names are skipped."""
    name = F.substring_index("path", "/", -1)
    named = walk.list_files(spark, root, ignore_files=()).withColumn("action_key", digests.manifest_key(name)).where("action_key is not null")
    text = walk.with_contents(named).select("action_key", F.decode("content", "UTF-8").alias("text"))
    own = MANIFEST.removeprefix("action_key string, ")
    return text.select("action_key", F.from_json("text", own).alias("m")).select("action_key", "m.*")


def manifest_json() -> Column:
    """A manifest's columns as JSON text."""
    return F.to_json(F.struct("recipe", "exit_code", "outputs", "stdout_digest", "stderr_digest", "execution_metadata"))


def new_blobs(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """(digest, content, size) of contents that the store lacks, each once."""
    keyed = blobs.where(F.col("content").isNotNull()).withColumn("digest", F.sha2("content", 256))
    once = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    return once.join(stored.select("digest"), "digest", "left_anti").withColumn("size", F.octet_length("content").cast("bigint"))


def put_blobs(blobs: DataFrame, path: str) -> None:
    """Appends what is new to a store of shards (the first digest byte)."""
    spark = blobs.sparkSession
    stored = read_blobs(spark, path)
    new_blobs(blobs, stored).withColumn("shard", digests.shard("digest")).repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(digest, content, size); a store that does not exist yet is empty."""
    shape = "digest string, content binary, size bigint, shard string"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], shape).drop("shard")
    return spark.read.schema(shape).parquet(path).drop("shard")


def list_blobs(spark: SparkSession, root: str) -> DataFrame:
    """(algorithm, digest) from names ``[prefix/]algorithm/shard/hex`` of a blob
    folder; other names are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -3).alias("algorithm"), F.element_at(parts, -2).alias("shard"), F.element_at(parts, -1).alias("digest"))
    return named.where(F.col("digest").rlike("^[0-9a-f]{64}$") & F.col("algorithm").isin(*digests.ALGORITHMS) & (F.substring("digest", 1, 2) == F.col("shard"))).select("algorithm", "digest")


def restore_plan(outputs: DataFrame, store: DataFrame) -> DataFrame:
    """(path, digest, size, mode, available): what restoring would write."""
    there = store.select("digest").distinct().withColumn("available", F.lit(True))
    mode = F.when(F.coalesce("is_executable", F.lit(False)), F.lit("755")).otherwise(F.lit("644"))
    return outputs.join(there, "digest", "left").select("path", "digest", "size", mode.alias("mode"), F.coalesce("available", F.lit(False)).alias("available"))


def log_name(fqn: Column | str) -> Column:
    return F.concat(F.replace(digests.col(fqn), F.lit(":"), F.lit(".")), F.lit(".log"))


def write_logs(results: DataFrame, path: str) -> None:
    """stdout, then stderr, of each result (fqn, stdout, stderr) under its log name."""
    text = F.concat(F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit("")))
    results.select(log_name("fqn").alias("log"), text.alias("value")).repartition("log").write.mode("overwrite").partitionBy("log").text(path)


def write_log_files(results: DataFrame, root: str) -> int:
    """The same, each as a file of that name in one folder."""
    text = F.concat(F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit("")))
    path = F.concat(F.lit(root.rstrip("/") + "/"), log_name("fqn"))
    return walk.write_files(results.where("fqn is not null").select(path.alias("path"), F.encode(text, "UTF-8").alias("content")))


def environment_values(names: list[str]) -> dict[str, str]:
    """Named variables only; unset ones are empty."""
    return {n: os.environ.get(n, "") for n in names}


def dump(df: DataFrame) -> DataFrame:
    """Records as JSON text, one per row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def clean_list(plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """Declared outputs of every planned node, dependencies included."""
    return nodes.join(plan.select("fqn"), "fqn", "left_semi").select("fqn", F.explode("cache.outputs").alias("output"))


def to_text(value: object) -> str:
    return json.dumps(value, sort_keys=True)
