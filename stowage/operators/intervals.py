"""Continuous periods and gaps of overlapping, nested and gapped intervals.

A sweep line without any whole-entity task. Boundaries become +1/-1 events,
aggregated map-side per (entity, instant). The running count of open intervals
is a prefix sum taken in two levels: within (entity, time bucket), and over the
buckets' net sums. Where the count rises from zero a period starts, where it
falls to zero one ends; starts and ends are paired the same two-level way. Only
one row per (entity, bucket) meets in an entity's window, so an entity with a
third of all rows is spread over its buckets.

Defined results: rows with null entity, start or end, or end <= start, are
ignored; touching intervals (end = next start) are one period; repeated and
nested rows change nothing; an empty input gives an empty result; other columns
are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Width of a time bucket in the unit of the input (microseconds: 4 days), and the
#: boundaries that a bucket of one entity may hold before the width is divided.
BUCKET = 4 * 86_400_000_000
BUCKET_ROWS = 2_000_000


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, max_gap: int | None = None, bucket: int | None = None) -> DataFrame:
    """(entity, kind, start_us, end_us) with kind ``busy`` or ``gap``; gaps longer
    than ``max_gap`` are left out where it is given. Without ``bucket`` its width is
    ``BUCKET``, divided where the busiest (entity, bucket) holds too many rows."""
    e, s, t = F.col(entity), F.col(start), F.col(end)
    rows = df.where(e.isNotNull() & s.isNotNull() & t.isNotNull() & (t > s))
    if bucket is None:
        full = rows.groupBy(e, F.floor(s / F.lit(BUCKET))).count().agg(F.max("count")).first()[0] or 0
        bucket = max(1, BUCKET // max(1, -(-2 * full // BUCKET_ROWS)))
    events = (
        rows.select(e.alias("k"), F.explode(F.array(F.struct(s.alias("at"), F.lit(1).alias("d")), F.struct(t.alias("at"), F.lit(-1).alias("d")))).alias("x"))
        .select("k", "x.at", "x.d")
        .groupBy("k", "at")
        .agg(F.sum("d").alias("d"))
        .withColumn("b", F.floor(F.col("at") / F.lit(bucket)))
    )
    # instants at which as many intervals end as begin neither open nor close a period
    events = events.where("d <> 0")
    upto = W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    nets = events.groupBy("k", "b").agg(F.sum("d").alias("net")).withColumn("base", F.coalesce(F.sum("net").over(upto), F.lit(0)))
    inside = W.partitionBy("k", "b").orderBy("at")
    counted = events.join(nets.select("k", "b", "base"), ["k", "b"]).withColumn("n", F.col("base") + F.sum("d").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    edges = counted.where((F.col("n") == 0) | (F.col("n") == F.col("d"))).select("k", "b", "at", (F.col("n") != 0).alias("opens"))
    firsts = edges.groupBy("k", "b").agg(F.min("at").alias("head")).withColumn("after", F.lead("head").over(W.partitionBy("k").orderBy("b")))
    paired = edges.withColumn("next", F.lead("at").over(inside)).join(firsts.select("k", "b", "after"), ["k", "b"])
    until = F.coalesce("next", "after")
    out = paired.where(until.isNotNull()).select(
        F.col("k").alias(entity),
        F.when(F.col("opens"), F.lit("busy")).otherwise(F.lit("gap")).alias("kind"),
        F.col("at").cast("bigint").alias("start_us"),
        until.cast("bigint").alias("end_us"),
    )
    return out if max_gap is None else out.where((F.col("kind") == "busy") | (F.col("end_us") - F.col("start_us") <= max_gap))
