"""A content-addressed store as tables: blob index, tiers, manifests.

blob_index(digest, algorithm, size, stored_at, access_count, last_accessed,
compression_format); tiers(tier, digest), 0 = fastest; manifests and their
outputs (action_key, path, digest, size, ...). Every lookup is one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut

#: Rows that a time bucket of the eviction order may hold.
BUCKET_ROWS = 1_000_000
INDEX_SCHEMA = "digest string, algorithm string, size bigint, stored_at bigint, access_count bigint, last_accessed bigint, compression_format int"

# -- index maintenance -----------------------------------------------------------


def upsert(index: DataFrame, puts: DataFrame, order: str = "stored_at") -> DataFrame:
    """Insert or replace: the latest put of a digest replaces its row whole."""
    both = index.withColumn("_new", F.lit(0)).unionByName(puts.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("digest", "_new")]
    best = both.groupBy("digest").agg(F.max_by(F.struct(*cols), F.struct("_new", order)).alias("_x"))
    return best.select("digest", "_x.*").select(*index.columns)


def new_rows(puts: DataFrame) -> DataFrame:
    """Index rows of puts (digest, algorithm, size, at): counted once, accessed now."""
    return puts.select(
        "digest", "algorithm", F.col("size").cast("bigint").alias("size"), F.col("at").alias("stored_at"),
        F.lit(1).cast("bigint").alias("access_count"), F.col("at").alias("last_accessed"), F.lit(0).alias("compression_format"),
    )


def touch(index: DataFrame, accesses: DataFrame) -> DataFrame:
    """Adds accesses (digest, at) to the counts and moves ``last_accessed`` forward;
    unknown digests change nothing."""
    per = accesses.groupBy("digest").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    joined = index.join(per, "digest", "left")
    return joined.withColumns(
        {"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.greatest("last_accessed", F.coalesce("_at", "last_accessed"))}
    ).select(*index.columns)


def delete(index: DataFrame, digests: DataFrame) -> DataFrame:
    """Without the given digests; absent ones are no error."""
    return index.join(digests.select("digest"), "digest", "left_anti")


def add_column(index: DataFrame, name: str, kind: str) -> DataFrame:
    """Schema migration: the column is added, null, unless it is there."""
    return index if name in index.columns else index.withColumn(name, F.lit(None).cast(kind))


# -- statistics --------------------------------------------------------------------


def index_stats(index: DataFrame) -> DataFrame:
    """(blobs, bytes, average); zero over an empty index."""
    return index.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes")).withColumn(
        "average", F.when(F.col("blobs") == 0, F.lit(0.0)).otherwise(F.col("bytes") / F.col("blobs"))
    )


def in_units(size: Column) -> list[Column]:
    return [(size / F.lit(1 << 20)).alias("mb"), (size / F.lit(1 << 30)).alias("gb")]


def storage_stats(refs: DataFrame) -> DataFrame:
    """Over references (digest, size): blobs, bytes, blobs referenced more than once,
    references to those, all references."""
    per = refs.groupBy("digest").agg(F.count("*").alias("links"), F.max("size").alias("size"))
    many = F.col("links") > 1
    return per.agg(
        F.count("*").alias("blobs"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(many).alias("shared_blobs"),
        F.coalesce(F.sum(F.when(many, F.col("links"))), F.lit(0)).alias("shared_links"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("refs"),
    )


def dedup_ratio(stats: DataFrame) -> DataFrame:
    """Adds ``ratio`` = (refs - blobs) / refs and ``saved`` = bytes div blobs times
    the repeated references."""
    again = F.col("refs") - F.col("blobs")
    return stats.withColumns(
        {
            "ratio": F.when(F.col("refs") == 0, F.lit(0.0)).otherwise(again / F.col("refs")),
            "saved": F.when(F.col("blobs") == 0, F.lit(0)).otherwise(F.expr("bytes div blobs") * again).cast("bigint"),
        }
    )


def link_savings(refs: DataFrame) -> DataFrame:
    """Bytes that links instead of copies save: every reference beyond the first."""
    return refs.groupBy("digest").agg(((F.count("*") - 1) * F.max("size")).alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("saved"))


def manifest_stats(manifests: DataFrame, size: Column) -> DataFrame:
    return manifests.agg(F.count("*").alias("manifests"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes")).withColumn(
        "average", F.when(F.col("manifests") == 0, F.lit(0.0)).otherwise(F.col("bytes") / F.col("manifests"))
    )


def output_sizes(outputs: DataFrame) -> DataFrame:
    """Total output size of each action."""
    return outputs.groupBy("action_key").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("output_bytes"), F.count("*").alias("outputs"))


def cached_bytes(index: DataFrame, manifests: DataFrame, size: Column) -> DataFrame:
    """Blob and manifest bytes together."""
    a = index.select(F.col("size").cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("m"))
    b = manifests.select(F.lit(0).cast("bigint").alias("b"), size.cast("bigint").alias("m"))
    sums = a.unionByName(b).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("blob_bytes"), F.coalesce(F.sum("m"), F.lit(0)).alias("manifest_bytes"))
    return sums.withColumn("bytes", F.col("blob_bytes") + F.col("manifest_bytes"))


def dedup(blobs: DataFrame) -> DataFrame:
    """One row per digest with its number of rows."""
    return blobs.groupBy("digest").agg(F.max("size").alias("size"), F.count("*").alias("copies"))


# -- lookups -------------------------------------------------------------------------


def contains_many(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Each wanted row with ``present``; the order column, if any, is kept."""
    there = store.select("digest").distinct().withColumn("_there", F.lit(True))
    return wanted.join(there, "digest", "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def to_upload(outputs: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct digests that the store lacks."""
    return outputs.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.max("size").alias("size")).join(store.select("digest"), "digest", "left_anti")


def size_lookup(wanted: DataFrame, tiers: DataFrame) -> DataFrame:
    """The size that the first tier with an answer gives; null if none has."""
    sizes = tiers.where(F.col("size").isNotNull()).groupBy("digest").agg(F.min_by("size", "tier").alias("size"))
    return wanted.join(sizes, "digest", "left")


def first_tier(wanted: DataFrame, tiers: DataFrame) -> DataFrame:
    """Each wanted digest with the lowest tier that holds it (null: none)."""
    return wanted.join(tiers.groupBy("digest").agg(F.min("tier").alias("tier")), "digest", "left")


def promotions(found: DataFrame) -> DataFrame:
    """(digest, tier) to copy into: every tier below the one that answered."""
    return found.where(F.col("tier") > 0).select("digest", F.explode(F.sequence(F.lit(0), F.col("tier") - 1)).alias("tier")).distinct()


def batch_get(wanted: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per batch the first tier that holds all of its digests, else null: a batch
    split over tiers is not served."""
    need = wanted.select("batch", "digest").distinct()
    sizes = need.groupBy("batch").agg(F.count("*").alias("need"))
    have = need.join(tiers.select("tier", "digest").distinct(), "digest").groupBy("batch", "tier").agg(F.count("*").alias("have"))
    full = have.join(sizes, "batch").where("have = need").groupBy("batch").agg(F.min("tier").alias("tier"))
    return sizes.select("batch").join(full, "batch", "left")


def listing(*stores: DataFrame) -> DataFrame:
    """Union of tier listings, each digest once."""
    out = stores[0].select("digest")
    for s in stores[1:]:
        out = out.unionByName(s.select("digest"))
    return out.distinct()


def put_all(puts: DataFrame, tiers: list[int]) -> DataFrame:
    """Rows to write for a put into every tier."""
    return puts.withColumn("tier", F.explode(F.array(*map(F.lit, tiers))))


def any_success(results: DataFrame, key: str = "digest") -> DataFrame:
    """A layered write holds if one tier's did."""
    return results.groupBy(key).agg(F.bool_or("ok").alias("ok"))


def manifest_lookup(keys: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """(action_key, manifest, backfill): the local manifest, else the remote one,
    which is then to be written back."""
    a = local.groupBy("action_key").agg(F.max("manifest").alias("_a"))
    b = remote.groupBy("action_key").agg(F.max("manifest").alias("_b"))
    joined = keys.join(a, "action_key", "left").join(b, "action_key", "left")
    return joined.withColumns({"manifest": F.coalesce("_a", "_b"), "backfill": F.col("_a").isNull() & F.col("_b").isNotNull()}).drop("_a", "_b")


def delete_manifests(manifests: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the given action keys; absent ones are no error."""
    return manifests.join(keys.select("action_key"), "action_key", "left_anti")


def manifests_exist(keys: DataFrame, manifests: DataFrame) -> DataFrame:
    """Each key with ``present``."""
    there = manifests.select("action_key").distinct().withColumn("_there", F.lit(True))
    return keys.join(there, "action_key", "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def verified(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """Outputs (path, digest) with ``ok``: whether the file's content has the digest."""
    have = files.groupBy("path").agg(F.max("digest").alias("_have"))
    return outputs.join(have, "path", "left").withColumn("ok", F.coalesce(F.col("_have") == F.col("digest"), F.lit(False))).drop("_have")


def cache_results(actions: DataFrame, outputs: DataFrame, store: DataFrame, files: DataFrame) -> DataFrame:
    """(action_key, result): ``hit`` if every output that must be restored (file
    absent or of another size) is in the store, ``miss`` if one is not or the action
    is unknown. ``outputs`` holds the known actions' outputs."""
    there = files.groupBy("path").agg(F.max("size").alias("_size"))
    rows = outputs.join(there, "path", "left").withColumn("_need", F.col("_size").isNull() | ~F.col("_size").eqNullSafe(F.col("size")))
    rows = rows.join(store.select("digest").distinct().withColumn("_there", F.lit(True)), "digest", "left")
    ok = rows.groupBy("action_key").agg(F.bool_and(~F.col("_need") | F.coalesce("_there", F.lit(False))).alias("_ok"))
    return actions.select("action_key").distinct().join(ok, "action_key", "left").select("action_key", F.when(F.col("_ok"), F.lit("hit")).otherwise(F.lit("miss")).alias("result"))


def succeeded(results: DataFrame) -> DataFrame:
    return results.where(F.col("exit_code") == 0)


def durations(results: DataFrame) -> DataFrame:
    """``duration_us``: never below zero; null where a time is."""
    us = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return results.withColumn("duration_us", F.when(us < 0, F.lit(0)).otherwise(us))


def failure_report(results: DataFrame, name: str = "recipe", message: str = "message") -> DataFrame:
    """All failures as ``name: message``, ordered by name, in one column of lines."""
    return results.where(F.col("exit_code") != 0).select(F.col(name).alias("fqn"), F.concat_ws(": ", name, message).alias("line")).orderBy("fqn", "line")


# -- eviction --------------------------------------------------------------------------


def lru(index: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """The least recently used; ties by ``stored_at``, then digest."""
    return index.orderBy("last_accessed", "stored_at", "digest").offset(offset).limit(n)


def largest(index: DataFrame, n: int) -> DataFrame:
    return index.orderBy(F.col("size").desc_nulls_last(), "digest").limit(n)


def freed(evicted: DataFrame) -> DataFrame:
    return evicted.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def evict_to_size(index: DataFrame, target: int, bucket: int = 3_600, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows to delete, least recently used first, until at most ``target`` bytes stay.

    The running sum is taken within time buckets and over the buckets' totals, so
    no task sorts the whole index: a row goes while the bytes before it are fewer
    than those to free. A row without size frees nothing. Where one bucket holds more
    than ``bucket_rows`` rows, ranges of the whole order take the place of the buckets.
    """
    order = ("last_accessed", "stored_at", "digest")
    rows = index.withColumn("_size", F.coalesce("size", F.lit(0)).cast("bigint")).withColumn("_b", F.floor(F.col("last_accessed") / F.lit(bucket)))
    rows = cut(rows)
    totals = rows.groupBy("_b").agg(F.sum("_size").alias("_t"), F.count("*").alias("_n"))
    most, count = totals.agg(F.max("_n"), F.sum("_n")).first()
    if (most or 0) > bucket_rows:
        ranged = rows.repartitionByRange(-(-count // bucket_rows) * 4, *order)
        rows = cut(ranged.withColumn("_b", F.spark_partition_id().cast("bigint")))  # sampled bounds, so kept
        totals = rows.groupBy("_b").agg(F.sum("_size").alias("_t"))
    upto = W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    # one row per bucket: this window is as long as the calendar, or as the ranges are many
    bases = totals.withColumns({"_base": F.coalesce(F.sum("_t").over(upto), F.lit(0)), "_need": F.sum("_t").over(whole) - F.lit(target)})
    open_ = bases.where(F.col("_base") < F.col("_need")).select(F.col("_b").alias("_c"), "_base", "_need")
    due = rows.join(open_, F.col("_b").eqNullSafe(F.col("_c")))
    w = W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("_size").over(w), F.lit(0))
    return due.withColumn("_before", before).where(F.col("_before") < F.col("_need")).select(*index.columns)
