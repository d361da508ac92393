"""References to records that do not exist (yet, any more or at all).

``find_orphans`` takes references (``ref``, ``at``) and parent lifetimes
(``key``, ``since``, ``until``). A Bloom filter over the parent keys, held as a
small table of 512-bit blocks, proves most dangling references ``missing``
without any shuffle of them; only references that the filter lets through are
verified by an exact join on the key. The filter's size is known from the
parents' count before it is built. It is broadcast in parts of at most
``MAX_FILTER_BYTES``, each probed in turn; where it takes more than ``MAX_PARTS``
of them, its blocks meet the references by a join on the block's number.

The parents are read once, into one row per (key, day), from which the filter and
the lifetimes come; a second time only where a reference falls on a day on which
its key was put more than once, for those keys.

Skew: parents are pre-aggregated map-side to one row per (key, day), then to one
per key with an entry per day; only references that these leave open meet the
single starts of one day (one per second). So a key that holds a third of the
puts never forms an unbounded group. A hot key among the
references only meets one parent row; AQE splits its partition.

Defined results: a null ``ref`` is no case; with a null ``at`` only ``missing``
can be decided, and is; parents with null key or ``since`` are ignored; rows
repeated alike count once; either table may be empty; columns not asked for in
``keep`` are dropped, so extra ones of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Bits of filter per parent key, bits set per key, 64-bit words per block.
BITS_PER_KEY, PROBES, WORDS = 16, 4, 8
MAX_FILTER_BYTES, MAX_PARTS = 32 << 20, 8
#: Keys that are broadcast at most.
BROADCAST_ROWS = 200_000
FOREVER = (1 << 62) - 1
DAY = 86_400


def _slot(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block, word in the block, and the bits that the key sets in the word."""
    h = F.xxhash64(key)
    block = F.pmod(h, F.lit(blocks)).cast("int")
    g = F.xxhash64(key, F.lit(7))
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    word = F.shiftrightunsigned(g, 60 - 20).bitwiseAND(F.lit(WORDS - 1)).cast("int")
    return block, word, mask


def bloom_blocks(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // (64 * WORDS)))


def bloom_table(parents: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): at most ``blocks`` rows, built with map-side bit_or."""
    b, w, m = _slot(F.col(key), blocks)
    zero = F.lit(0).cast("bigint")
    words = [F.bit_or(F.when(F.col("_w") == i, F.col("_m")).otherwise(zero)).alias(f"_w{i}") for i in range(WORDS)]
    return parents.where(F.col(key).isNotNull()).select(b.alias("_block"), w.alias("_w"), m.alias("_m")).groupBy("_block").agg(*words)


def bloom_probe(refs: DataFrame, key: str, table: DataFrame, blocks: int, parts: int = 1, max_parts: int = MAX_PARTS) -> DataFrame:
    """``refs`` with ``_maybe``: false proves that the key has no parent."""
    b, w, m = _slot(F.col(key), blocks)
    words = [f"_w{i}" for i in range(WORDS)]
    held = F.element_at(F.array(*map(F.col, words)), w + 1)
    known = F.coalesce(held.bitwiseAND(m) == m, F.lit(False))
    out = refs.withColumns({"_block": b, "_maybe": F.lit(False)})
    if parts > max_parts:
        return out.join(table, "_block", "left").withColumn("_maybe", known).drop("_block", *words)
    for n in range(parts):
        # a block lies in one part; elsewhere the join finds nothing
        mine = table if parts == 1 else table.where(F.pmod("_block", F.lit(parts)) == n)
        out = out.join(F.broadcast(mine), "_block", "left").withColumn("_maybe", F.col("_maybe") | known).drop(*words)
    return out.drop("_block")


def _days(puts: DataFrame) -> DataFrame:
    """Per (key, day): the first start with its latest end, the latest end of all, and
    whether there is more than one start."""
    lead = F.min(F.struct("since", (-F.col("until")).alias("minus"))).alias("lead")
    out = puts.groupBy("key", "day").agg(lead, F.max("until").alias("last"), F.max("since").alias("_end"))
    return out.select("key", "day", "lead", "last", (F.col("_end") > F.col("lead.since")).alias("many"))


def find_orphans(refs: DataFrame, parents: DataFrame, keep: list[str] | None = None, max_filter_bytes: int = MAX_FILTER_BYTES, max_parts: int = MAX_PARTS) -> DataFrame:
    """(keep..., ref, at, reason) of the references whose ``ref`` has no parent alive
    at second ``at``: ``missing``, ``late`` (all parents begin later) or ``deleted``.

    ``keep``: the columns to carry along (none by default); they come back under
    their names, whatever these are, unless one is ``ref``, ``at`` or ``reason``.
    """
    keep = [c for c in keep or [] if c not in ("ref", "at", "reason")]
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    refs = refs.where(F.col("ref").isNotNull()).select("ref", F.col("at").cast("bigint").alias("at"), carried.alias("x"))
    since, until = F.col("since").cast("bigint"), F.col("until").cast("bigint")
    puts = parents.where(F.col("key").isNotNull() & F.col("since").isNotNull()).select("key", since.alias("since"), F.coalesce(until, F.lit(FOREVER)).alias("until"))
    puts = puts.withColumn("day", F.expr(f"since div {DAY}"))
    days = cut(_days(puts))
    blocks = bloom_blocks(days.count())
    parts = -(-blocks * 8 * WORDS // max_filter_bytes)
    probed = bloom_probe(refs, "ref", bloom_table(days, "key", blocks), blocks, parts, max_parts)
    absent = probed.where(~F.col("_maybe")).select("ref", "at", "x", F.lit("missing").alias("reason"))
    asked = probed.where("_maybe").select("ref", "at", "x")

    per_key = days.groupBy("key").agg(F.min("lead").alias("_lead"), F.collect_list(F.struct("day", "last", "many", F.col("lead.since").alias("since"), (-F.col("lead.minus")).alias("until"))).alias("_days"))
    at, first = F.col("at"), F.col("_lead.since")
    day = F.expr(f"at div {DAY}")
    today = lambda d: (d["day"] == day) & (d["since"] <= at) & (d["until"] > at)
    alive = ((at >= first) & (at < -F.col("_lead.minus"))) | F.exists("_days", lambda d: ((d["day"] < day) & (d["last"] > at)) | today(d))
    unsure = F.exists("_days", lambda d: (d["day"] == day) & d["many"] & (d["last"] > at))
    reason = F.when(F.col("_lead").isNull(), F.lit("missing")).when(at < first, F.lit("late")).when(unsure, F.lit("open")).otherwise(F.lit("deleted"))
    joined = asked.join(per_key.withColumnRenamed("key", "ref"), "ref", "left")
    present = joined.where(F.col("_lead").isNull() | (at.isNotNull() & ~alive)).select("ref", "at", "x", reason.alias("reason"))
    found = cut(absent.unionByName(present))
    out = found.where("reason <> 'open'")
    # few are left: those of a day on which their key was put again
    doubtful = found.where("reason = 'open'").withColumn("_day", day)
    keys = doubtful.select(F.col("ref").alias("key"), F.col("_day").alias("day")).distinct()
    left = keys.count()
    if left:
        named = F.broadcast(keys) if left <= BROADCAST_ROWS else keys
        starts = puts.join(named, ["key", "day"], "left_semi").groupBy("key", "day", "since").agg(F.max("until").alias("until"))
        per_day = starts.groupBy("key", "day").agg(F.collect_list(F.struct("since", "until")).alias("_starts")).withColumnsRenamed({"key": "ref", "day": "_day"})
        same_day = F.exists("_starts", lambda s: (s["since"] <= at) & (s["until"] > at))
        rest = doubtful.join(per_day, ["ref", "_day"], "left").where(~F.coalesce(same_day, F.lit(False)))
        out = out.unionByName(rest.select("ref", "at", "x", F.lit("deleted").alias("reason")))
    return out.select(*[F.col("x")[c].alias(c) for c in keep], "ref", "at", "reason").dropDuplicates()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, period and reason."""
    return orphans.groupBy("source_table", "period", "reason").agg(F.count("*").alias("orphans"), F.countDistinct("ref").alias("targets"))
