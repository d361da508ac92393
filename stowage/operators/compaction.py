"""Millions of tiny files into fewer well-sized containers.

``container_plan`` decides where each small file goes: container, offset and
length. ``pack`` writes the bytes: each container is one row with a block (the
original bytes one after the other) and an index of path, offset, length and
checksum; ``unpack`` and ``lookup`` read them back, in parallel, byte for byte.
``write_archive`` keeps them: a file per block and an index table beside, from which
``archive_lookup`` finds a file without opening any other block.

Containers fill across groups (directories): one running sum over all files, of
sizes and ``ENTRY_BYTES`` per index entry, is cut into stretches of
``target_bytes``. A file never spans containers; a container holds the files that
begin in its stretch, so all but the last are about full. The sum is taken within
lanes and over the lanes' totals: whole groups share a lane by hash, and a group of
more than ``lane_files`` files is split over several by a hash of the path, so no
task holds a whole hot group. The input is read twice (totals, then files): cut an
expensive one first. ``group_plan`` cuts each group for itself instead.

Defined results: files with null path or size are not packed; empty files take
an index entry of length 0; of repeated paths each row must be one file
(callers reduce to current rows first); files in no group (null) are one group;
empty input gives no containers; extra columns stay, but those of the names that
the plan adds (container, offset, length) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources import walk

SMALL_BYTES = 65_536
CROWDED = 20
TARGET_BYTES = 32 << 20
LANE_FILES = 65_536
#: Lanes that groups share; what an index entry counts for, which bounds the files of a container.
LANES, ENTRY_BYTES = 65_536, 128


def crowded_small_files(files: DataFrame, group: str = "directory", small: int = SMALL_BYTES, crowd: int = CROWDED) -> DataFrame:
    """Files below ``small`` bytes in groups that hold ``crowd`` or more of them;
    adds ``group_files``. Counted with a partial aggregate, then joined back."""
    tiny = files.drop("group_files").where(F.col("size") < small)
    counts = tiny.groupBy(group).agg(F.count("*").alias("group_files")).where(F.col("group_files") >= crowd)
    return _with_counts(tiny, counts, group)


def _with_counts(files: DataFrame, counts: DataFrame, group: str) -> DataFrame:
    """Joined on the group, where null is a group like any other."""
    named = counts.withColumnRenamed(group, "_group")
    return files.join(named, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def _placeable(files: DataFrame, lane_files: int) -> DataFrame:
    files = files.drop("container", "offset", "length", "_shared", "_lane", "_before", "_cost", "_no", "_start", "_start_cost")
    lanes = F.ceil(F.col("group_files") / F.lit(lane_files))
    lane = F.pmod(F.xxhash64("path"), lanes).cast("int")
    return files.where(F.col("path").isNotNull() & F.col("size").isNotNull()).withColumn("_lane", lane)


def _sum_before(column: str | Column, w: W) -> Column:
    return F.coalesce(F.sum(column).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def container_plan(files: DataFrame, group: str = "directory", target_bytes: int = TARGET_BYTES, lane_files: int = LANE_FILES) -> DataFrame:
    """Adds ``container`` (its number, as text), ``offset`` and ``length`` to files
    with ``path``, ``size`` and ``group_files``; containers fill across groups."""
    placed = _placeable(files, lane_files).withColumn("_shared", F.pmod(F.xxhash64(group), F.lit(LANES)).cast("int"))
    cost = F.col("size") + ENTRY_BYTES
    # at most LANES rows and one per lane_files files
    totals = placed.groupBy("_shared", "_lane").agg(F.sum("size").alias("_bytes"), F.sum(cost).alias("_costs"))
    w = W.orderBy("_shared", "_lane")
    starts = totals.select("_shared", "_lane", _sum_before("_bytes", w).alias("_start"), _sum_before("_costs", w).alias("_start_cost"))
    w = W.partitionBy("_shared", "_lane").orderBy(group, "path")
    placed = placed.withColumns({"_before": _sum_before("size", w), "_cost": _sum_before(cost, w)})
    placed = placed.join(F.broadcast(starts), ["_shared", "_lane"]).withColumn("_before", F.col("_before") + F.col("_start"))
    placed = placed.withColumn("_no", F.expr(f"(_cost + _start_cost) div {target_bytes}"))
    first = F.min("_before").over(W.partitionBy("_no"))
    placed = placed.withColumns({"container": F.col("_no").cast("string"), "offset": F.col("_before") - first, "length": F.col("size")})
    return placed.drop("_shared", "_lane", "_before", "_cost", "_no", "_start", "_start_cost")


def group_plan(files: DataFrame, group: str = "directory", target_bytes: int = TARGET_BYTES, lane_files: int = LANE_FILES) -> DataFrame:
    """Like ``container_plan``, but no container holds files of two groups or lanes:
    ``container`` is group, lane and number, and a small group gets a small container."""
    w = W.partitionBy(group, "_lane").orderBy("path")
    placed = _placeable(files, lane_files).withColumn("_before", _sum_before("size", w))
    placed = placed.withColumn("_no", F.expr(f"_before div {target_bytes}"))
    first = F.min("_before").over(W.partitionBy(group, "_lane", "_no"))
    placed = placed.withColumn("offset", F.col("_before") - first)
    name = F.concat_ws("#", F.col(group), F.col("_lane").cast("string"), F.col("_no").cast("string"))
    return placed.withColumns({"container": name, "length": F.col("size")}).drop("_lane", "_before", "_no")


def container_sizes(plan: DataFrame) -> DataFrame:
    return plan.groupBy("container").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def planned_index(plan: DataFrame, *more: str) -> DataFrame:
    """(container, index): what each planned container will list, with columns ``more``."""
    return plan.groupBy("container").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "path", *more))).alias("index"))


def pack(files: DataFrame, group: str = "directory", target_bytes: int = TARGET_BYTES, lane_files: int = LANE_FILES) -> DataFrame:
    """(container, block, index) of files with ``path`` and ``content`` (binary)."""
    sized = files.select(group, "path", "content").where(F.col("content").isNotNull() & F.col("path").isNotNull()).withColumn("size", F.octet_length("content").cast("bigint"))
    counts = sized.groupBy(group).agg(F.count("*").alias("group_files"))
    plan = container_plan(_with_counts(sized, counts, group), group, target_bytes, lane_files)
    # an empty file sorts before the one that begins at its offset, as in the block
    entry = F.struct("offset", "length", "path", F.sha2("content", 256).alias("checksum"))
    return plan.select("container", "offset", "content", entry.alias("e")).groupBy("container").agg(
        F.expr("listagg(content) within group (order by offset, e.length, e.path)").alias("block"), F.array_sort(F.collect_list("e")).alias("index")
    )


def _slice(e: str) -> Column:
    return F.substring(F.col("block"), F.col(f"{e}.offset").cast("int") + 1, F.col(f"{e}.length").cast("int"))


def unpack(containers: DataFrame) -> DataFrame:
    """(path, content, ok): every file again; ``ok`` is whether its checksum holds."""
    rows = containers.select("block", F.explode("index").alias("e")).select(F.col("e.path").alias("path"), _slice("e").alias("content"), F.col("e.checksum").alias("checksum"))
    return rows.select("path", "content", (F.sha2("content", 256) == F.col("checksum")).alias("ok"))


def lookup(containers: DataFrame, paths: list[str]) -> DataFrame:
    """The named files only, of containers held as a table: the index is searched
    before any block is cut. An archive finds them without reading other blocks."""
    wanted = F.filter("index", lambda e: e["path"].isin(paths))
    hit = containers.withColumn("index", wanted).where(F.size("index") > 0)
    return unpack(hit)


# -- archives -----------------------------------------------------------------------

ENTRY = "path string, container string, offset bigint, length bigint, checksum string"
#: Folders of an archive's index: what a lookup of one path opens at least.
INDEX_BUCKETS = 64


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def write_archive(files: DataFrame, root: str, group: str = "directory", target_bytes: int = TARGET_BYTES, lane_files: int = LANE_FILES, buckets: int = INDEX_BUCKETS) -> None:
    """Packs files (``path``, ``content``) into an archive: each container's block is one
    file of ``root/blocks``, and ``root/index`` is a table of its own, by buckets of the
    path and sorted by it. A block is written by the task that holds it, under a name
    that depends on the data alone, so a repeated task writes the same file again."""
    blocks = root.rstrip("/") + "/blocks/"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, index in zip(*(batch.column(c) for c in ("container", "block", "index"))):
                walk.write_bytes(blocks + name.as_py(), block.as_py())
                e = index.values
                fields = [e.field("path"), pa.array([name.as_py()] * len(e), pa.string()), e.field("offset"), e.field("length"), e.field("checksum")]
                yield pa.RecordBatch.from_arrays(fields, names=["path", "container", "offset", "length", "checksum"])

    packed = pack(files, group, target_bytes, lane_files).select("container", "block", "index")
    entries = packed.mapInArrow(run, ENTRY).withColumn("bucket", _bucket(F.col("path"), buckets))
    entries.repartition("bucket").sortWithinPartitions("bucket", "path").write.mode("overwrite").partitionBy("bucket").parquet(root.rstrip("/") + "/index")


def archive_index(spark: SparkSession, root: str) -> DataFrame:
    """(path, container, offset, length, checksum, bucket) of every file of an archive."""
    return spark.read.schema(ENTRY + ", bucket int").parquet(root.rstrip("/") + "/index")


def read_archive(entries: DataFrame, root: str) -> DataFrame:
    """(path, content, ok) of the given index entries: only their ranges of the named
    blocks are read, in the order in which they lie."""
    blocks = root.rstrip("/") + "/blocks/"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, held, size, begin = batch.column("path"), [], 0, 0
            places = list(zip(*(batch.column(c).to_pylist() for c in ("container", "offset", "length"))))
            for n, (name, offset, length) in enumerate(places):
                held.append(walk.read_range(blocks + name, offset, length))
                size += length
                if size >= TARGET_BYTES or n + 1 == len(places):
                    part = slice(begin, n + 1)
                    yield pa.RecordBatch.from_arrays([paths[part], pa.array(held, pa.binary()), batch.column("checksum")[part]], names=["path", "content", "checksum"])
                    held, size, begin = [], 0, n + 1

    rows = entries.select("path", "container", "offset", "length", "checksum")
    rows = rows.repartition("container").sortWithinPartitions("container", "offset")
    out = rows.mapInArrow(run, "path string, content binary, checksum string")
    return out.select("path", "content", (F.sha2("content", 256) == F.col("checksum")).alias("ok"))


def archive_lookup(spark: SparkSession, root: str, paths: list[str], buckets: int = INDEX_BUCKETS) -> DataFrame:
    """(path, content, ok) of the named files: their buckets of the index are searched,
    then their ranges of the named blocks read. Names that are not there give no row."""
    named = spark.createDataFrame([(p,) for p in set(paths)], "path string").select(_bucket(F.col("path"), buckets).alias("b")).distinct()
    within = [r.b for r in named.collect()]  # no more than the names given
    entries = archive_index(spark, root).where(F.col("bucket").isin(within) & F.col("path").isin(list(set(paths))))
    return read_archive(entries, root)
