"""Has this key been seen before? Ribbon filters over sealed batches of keys.

Keys are spread over shards by hash. In a shard, records come in id order; the
newest keys are an exact open batch, and each full batch is sealed into a
ribbon filter (about 45 bits per key at 32 fingerprint bits, against 71 bytes
of digest). A record whose key is in the open batch or matches a sealed filter
was seen before. There are no false negatives; the chance of a false positive
is at most (sealed batches of the shard) * 2**-bits, and ``audit`` measures it
with keys that are certainly absent.

``seal`` keeps the filters: it adds a generation of filters of all new keys to a
store, and ``probe`` answers later records from the stored generations alone. So
neither old records nor old keys are read, moved or sorted again; a key costs about
45 bits of the store. ``advance`` does both for a batch of records, ``audit_store``
probes what is stored with absent keys.

Scale: keys travel as 128-bit hashes. A map-side combiner settles repetitions
inside a block of the input at once, so a key that holds a third of all rows
sends one row per block to its shard; the settled rows bypass the shards. The
number of shards follows the row count, which bounds a shard's filters. A store's
shards are fixed when it begins; a shard that a hot key fills is probed by several
tasks, each with the shard's filters.

Defined results: rows with null id or null key are no cases; a repeated id is
one record and no earlier occurrence of itself; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shuffle_partitions
from .ribbon import Ribbon

#: Fingerprint bits, keys per sealed batch, rows per block of the combiner.
BITS, BATCH_KEYS, BLOCK_ROWS = 32, 4_096, 131_072
#: Rows per shard (about a dozen batches) and per task.
SHARD_ROWS, TASK_ROWS = 50_000, 250_000
ABSENT_PER_BATCH = 4_096
#: Keys of one stored filter (about 1.4 MB), and the least number of shards of a store.
STORE_KEYS, STORE_SHARDS = 250_000, 16

_ROW = "part int, id bigint, hi bigint, lo bigint, shard int"
_KEY = np.dtype([("hi", "<u8"), ("lo", "<u8")])


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[dict[str, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield {n: np.concatenate([_column(b, n) for b in held]) for n in held[0].schema.names}
            held = []
    if held:
        yield {n: np.concatenate([_column(b, n) for b in held]) for n in held[0].schema.names}


def _combine(shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches, BLOCK_ROWS):
            order = np.lexsort((x["id"], x["lo"], x["hi"], x["part"]))
            part, ids, hi, lo = (x[n][order] for n in ("part", "id", "hi", "lo"))
            head = np.ones(len(ids), bool)
            head[1:] = (part[1:] != part[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            first = np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))
            known = ids > ids[first]
            keep = known | head
            shard = (hi.view(np.uint64) % np.uint64(shards)).astype(np.int32)
            shard[known] = -1 - (ids[known] % shards).astype(np.int32)
            hi, lo = np.where(known, 0, hi), np.where(known, 0, lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[keep]) for a in (part.astype(np.int32), ids.astype(np.int64), hi.astype(np.int64), lo.astype(np.int64), shard)],
                names=["part", "id", "hi", "lo", "shard"],
            )

    return run


class _Shard:
    """Open batch and sealed filters of one shard."""

    def __init__(self, bits: int, batch_keys: int):
        self.bits, self.batch_keys, self.filters = bits, batch_keys, []
        self.open = np.empty(0, _KEY)
        self.keys = 0
        # the newest id and its keys: it may be delivered again in the next call
        self.last, self.last_keys = None, set()

    def seen(self, ids: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """For rows in id order, whether each key came before; takes the new keys in."""
        keys = np.empty(len(ids), _KEY)
        keys["hi"], keys["lo"] = hi.view(np.uint64), lo.view(np.uint64)
        both, first, inverse = np.unique(np.concatenate([self.open, keys]), return_index=True, return_inverse=True)
        n = len(self.open)
        inverse = inverse[n:]
        fresh = first >= n  # not in the open batch
        asked = np.flatnonzero(fresh)
        old = np.zeros(len(asked), bool)
        for f in self.filters:
            rest = np.flatnonzero(~old)
            old[rest] = f.contains(both["hi"][asked[rest]], both["lo"][asked[rest]])
        before = ~fresh
        before[asked[old]] = True
        begin = np.where(fresh, first - n, 0)
        out = before[inverse] | (ids > ids[begin[inverse]])
        if len(ids):
            again = np.flatnonzero(ids == self.last) if self.last is not None else np.empty(0, np.int64)
            # answered already, and no earlier occurrence of itself
            out[[n for n in again.tolist() if keys[n].item() in self.last_keys]] = False
            if ids[-1] != self.last:
                self.last, self.last_keys = ids[-1], set()
            self.last_keys.update(keys[ids == self.last].tolist())
        new = both[asked[~old]]
        self.keys += len(new)
        self.open = np.concatenate([self.open, new])
        while len(self.open) >= self.batch_keys:
            full, self.open = self.open[: self.batch_keys], self.open[self.batch_keys :]
            self.filters.append(Ribbon(full["hi"].copy(), full["lo"].copy(), self.bits))
        return out


def _shards(batches: Iterable[pa.RecordBatch], bits: int, batch_keys: int) -> Iterator[tuple[int, int, _Shard | None, np.ndarray, np.ndarray | None]]:
    """Per run of rows of one (shard, part), sorted by id: its state, ids, answers."""
    now, state = None, None
    for x in _blocks(batches, batch_keys):
        key = x["shard"].astype(np.int64) * 256 + x["part"]
        cuts = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(key)]):
            shard, part, ids = int(x["shard"][a]), int(x["part"][a]), x["id"][a:b]
            if shard < 0:
                yield shard, part, None, ids, None
                continue
            if now != (shard, part):
                if state is not None:
                    yield now[0], now[1], state, np.empty(0, np.int64), None
                now, state = (shard, part), _Shard(bits, batch_keys)
            yield shard, part, None, ids, state.seen(ids, x["hi"][a:b], x["lo"][a:b])
    if state is not None:
        yield now[0], now[1], state, np.empty(0, np.int64), None


def _answer(bits: int, batch_keys: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part, _, ids, seen in _shards(batches, bits, batch_keys):
            ids = ids if shard < 0 else ids[seen] if seen is not None else ids
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(ids.astype(np.int64))], names=["part", "id"])

    return run


def _audit(bits: int, batch_keys: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part, state, _, _ in _shards(batches, bits, batch_keys):
            if state is None:
                continue
            # absent: 128-bit keys drawn apart from the data, checked against nothing but chance 2**-128
            draw = np.random.default_rng([shard, part, 20])
            probes = ABSENT_PER_BATCH * max(1, len(state.filters))
            hi, lo = (draw.integers(0, 1 << 63, probes, dtype=np.int64).view(np.uint64) for _ in range(2))
            wrong = np.zeros(probes, bool)
            for f in state.filters:
                wrong |= f.contains(hi, lo)
            row = [part, state.keys, len(state.filters), sum(f.nbytes for f in state.filters), probes, int(wrong.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names=["part", "keys", "filters", "bytes", "probes", "wrong"])

    return run


def _sharded(parts: list[DataFrame], rows: int | None) -> DataFrame:
    """Rows of all parts (id, key) with local repetitions settled, by shard, in id order."""
    keyed = None
    for i, df in enumerate(parts):
        key: Column = F.col("key")
        one = df.where(F.col("id").isNotNull() & key.isNotNull()).select(
            F.lit(i).alias("part"), F.col("id").cast("bigint").alias("id"), F.xxhash64(key).alias("hi"), F.xxhash64(F.lit(31), key).alias("lo")
        )
        keyed = one if keyed is None else keyed.unionByName(one)
    count = rows if rows is not None else sum(df.count() for df in parts)
    shards = max(1, -(-count // SHARD_ROWS))
    tasks = min(shards, max(shuffle_partitions(keyed.sparkSession), -(-count // TASK_ROWS)))
    settled = keyed.mapInArrow(_combine(shards), _ROW)
    return settled.repartition(tasks, "shard").sortWithinPartitions("shard", "part", "id")


def seen_before(parts: list[DataFrame], bits: int = BITS, rows: int | None = None, batch_keys: int = BATCH_KEYS) -> DataFrame:
    """(part, id) of the rows of ``parts`` (each with id, key) whose key occurs in
    the same part under a smaller id."""
    return _sharded(parts, rows).mapInArrow(_answer(bits, batch_keys), "part int, id bigint").dropDuplicates()


def audit(parts: list[DataFrame], bits: int = BITS, rows: int | None = None, batch_keys: int = BATCH_KEYS) -> DataFrame:
    """Per part: keys held, sealed filters, their bytes, certainly absent keys
    probed, wrong answers among them, the measured rate and the expected bound."""
    per = _sharded(parts, rows).mapInArrow(_audit(bits, batch_keys), "part bigint, keys bigint, filters bigint, bytes bigint, probes bigint, wrong bigint")
    bound = F.max("filters") * F.lit(2.0**-bits)
    out = per.groupBy("part").agg(*[F.sum(c).alias(c) for c in ("keys", "filters", "bytes", "probes", "wrong")], bound.alias("bound"))
    return out.withColumn("rate", F.col("wrong") / F.col("probes"))


# -- sealed generations ---------------------------------------------------------------

_STORED = "generation int, shards int, shard int, no int, keys bigint, bits int, payload binary"
_MIXED = "shard int, salt int, kind int, no int, hi bigint, lo bigint, id bigint, payload binary"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The filters of all generations of a store; none if it does not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(_STORED).parquet(path)


def _hashed(df: DataFrame, shards: int, with_id: bool) -> DataFrame:
    key = F.col("key")
    rows = df.where(key.isNotNull() & F.col("id").isNotNull()) if with_id else df.where(key.isNotNull())
    rows = rows.select(F.xxhash64(key).alias("hi"), F.xxhash64(F.lit(31), key).alias("lo"), (F.col("id").cast("bigint") if with_id else F.lit(0).cast("bigint")).alias("id"))
    # unsigned remainder, as in the shards of a single pass
    return rows.withColumn("shard", F.pmod(F.xxhash64("hi"), F.lit(shards)).cast("int"))


def _mixed(rows: DataFrame, held: DataFrame | None, count: int) -> DataFrame:
    """Records (kind 1) after the filters (kind 0) of their shard, by shard and salt."""
    salts = rows.groupBy("shard").count().where(F.col("count") > 2 * TASK_ROWS).select("shard", F.ceil(F.col("count") / TASK_ROWS).cast("int").alias("salts"))
    salts = F.broadcast(cut(salts))  # at most one row per 2 * TASK_ROWS records
    null, zero = F.lit(None), F.lit(0)
    many = F.coalesce("salts", F.lit(1))
    out = rows.join(salts, "shard", "left").select(
        "shard", F.pmod(F.xxhash64("id", "hi"), many).cast("int").alias("salt"), F.lit(1).alias("kind"), zero.alias("no"), "hi", "lo", "id", null.cast("binary").alias("payload")
    )
    if held is not None:
        filters = held.join(salts, "shard", "left").select(
            "shard", F.explode(F.sequence(F.lit(0), many - 1)).alias("salt"), zero.alias("kind"), "no",
            F.col("generation").cast("bigint").alias("hi"), zero.cast("bigint").alias("lo"), zero.cast("bigint").alias("id"), "payload",
        )
        out = filters.unionByName(out)
    tasks = max(shuffle_partitions(rows.sparkSession), -(-count // TASK_ROWS))
    return out.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "hi", "lo", "no")


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[Ribbon], dict[str, np.ndarray]]]:
    """Per run of records of one (shard, salt): the shard, its stored filters, the rows."""
    now, filters = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, salt, kind = (_column(batch, c) for c in ("shard", "salt", "kind"))
        cuts = np.flatnonzero(np.diff(shard) | np.diff(salt) | np.diff(kind)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shard)]):
            if now != (shard[a], salt[a]):
                now, filters = (shard[a], salt[a]), []
            if kind[a] == 0:
                filters += [Ribbon.load(x) for x in batch.column("payload").slice(a, b - a).to_pylist()]
            else:
                yield int(shard[a]), filters, {c: _column(batch, c)[a:b] for c in ("hi", "lo", "id")}


def _held(filters: list[Ribbon], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    old = np.zeros(len(hi), bool)
    for f in filters:
        rest = np.flatnonzero(~old)
        old[rest] = f.contains(hi[rest], lo[rest])
    return old


def _seal(generation: int, shards: int, bits: int, store_keys: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, no, new, size, newest = None, 0, [], 0, None

        def filters(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal no, new, size
            keys = np.unique(np.concatenate(new)) if new else np.empty(0, _KEY)
            while len(keys) >= store_keys or (last and len(keys)):
                full, keys = keys[:store_keys], keys[store_keys:]
                f = Ribbon(full["hi"].copy(), full["lo"].copy(), bits)
                row = [generation, shards, now, no, len(full), bits, f.dump()]
                kinds = [pa.int32()] * 4 + [pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["generation", "shards", "shard", "no", "keys", "bits", "payload"])
                no += 1
            new, size = ([keys] if len(keys) else []), len(keys)

        for shard, held, x in _streamed(batches):
            if shard != now:
                yield from filters(True)
                now, no, new, size, newest = shard, 0, [], 0, None
            keys = np.empty(len(x["hi"]), _KEY)
            keys["hi"], keys["lo"] = x["hi"].view(np.uint64), x["lo"].view(np.uint64)
            # rows come in key order: a key of an earlier batch can only be its last
            last, keys = keys[-1], np.unique(keys[keys != newest] if newest is not None else keys)
            newest = last
            keys = keys[~_held(held, keys["hi"].copy(), keys["lo"].copy())]
            if len(keys):
                new.append(keys)
                size += len(keys)
            if size >= store_keys:
                yield from filters(False)
        yield from filters(True)

    return run


def _local_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key once per block of the input."""
    for x in _blocks(batches, BLOCK_ROWS):
        order = np.lexsort((x["lo"], x["hi"]))
        hi, lo = x["hi"][order], x["lo"][order]
        head = order[np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]]
        yield pa.RecordBatch.from_arrays([pa.array(x[c][head]) for c in ("hi", "lo", "id", "shard")], names=["hi", "lo", "id", "shard"])


def _generation(held: DataFrame | None) -> tuple[int, int]:
    """The number of the next generation and the store's shards (0: not yet known)."""
    last = None if held is None else held.agg(F.max("generation"), F.max("shards")).first()
    return (0, 0) if last is None or last[0] is None else (last[0] + 1, last[1])


def seal(df: DataFrame, path: str, bits: int = BITS, shards: int | None = None, store_keys: int = STORE_KEYS) -> int:
    """Adds a generation with the keys (``key``) of ``df`` that the store at ``path``
    does not hold yet; returns its number. The first one fixes the store's shards."""
    spark = df.sparkSession
    held = stored(spark, path)
    generation, fixed = _generation(held)
    count = df.count()
    shards = fixed or shards or max(STORE_SHARDS, -(-count // store_keys))
    rows = _hashed(df, shards, False).mapInArrow(_local_keys, "hi bigint, lo bigint, id bigint, shard int")
    # keys, not records: no key is hot here, and no shard is salted
    null, zero = F.lit(None), F.lit(0)
    new = rows.select("shard", zero.alias("salt"), F.lit(1).alias("kind"), zero.alias("no"), "hi", "lo", "id", null.cast("binary").alias("payload"))
    if held is not None:
        big = F.col("generation").cast("bigint")
        new = held.select("shard", zero.alias("salt"), zero.alias("kind"), "no", big.alias("hi"), zero.cast("bigint").alias("lo"), zero.cast("bigint").alias("id"), "payload").unionByName(new)
    tasks = min(shards, max(shuffle_partitions(spark), -(-count // TASK_ROWS)))
    sorted_ = new.repartition(tasks, "shard").sortWithinPartitions("shard", "kind", "hi", "lo", "no")
    sorted_.mapInArrow(_seal(generation, shards, bits, store_keys), _STORED).write.mode("append").parquet(path)
    return generation


def probe(df: DataFrame, path: str) -> DataFrame:
    """(id) of the records (id, key) whose key a sealed generation holds; a store that
    does not exist holds nothing."""
    held = stored(df.sparkSession, path)
    _, shards = _generation(held)
    if not shards:
        return df.sparkSession.createDataFrame([], "id bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, filters, x in _streamed(batches):
            old = _held(filters, x["hi"].view(np.uint64), x["lo"].view(np.uint64))
            if old.any():
                yield pa.RecordBatch.from_arrays([pa.array(x["id"][old])], names=["id"])

    return _mixed(_hashed(df, shards, True), held, df.count()).mapInArrow(run, "id bigint").dropDuplicates()


def advance(df: DataFrame, path: str, bits: int = BITS) -> DataFrame:
    """(id) of the records of a new batch whose key came before, in a sealed generation
    or under a smaller id of the batch; then the batch's new keys are sealed. Ids are of
    later records than those sealed."""
    old = probe(df, path).unionByName(seen_before([df], bits).select("id"))
    old = cut(old.dropDuplicates())
    seal(df, path, bits)
    return old


def audit_store(spark: SparkSession, path: str) -> DataFrame:
    """(keys, filters, bytes, probes, wrong, rate, bound) of a store, measured on the
    stored filters with keys that are certainly absent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, generation, no, keys, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "generation", "no", "keys", "payload"))):
                f = Ribbon.load(data)
                draw = np.random.default_rng([shard, generation, no, 20])
                probes = ABSENT_PER_BATCH * max(1, keys // BATCH_KEYS)
                hi, lo = (draw.integers(0, 1 << 63, probes, dtype=np.int64).view(np.uint64) for _ in range(2))
                row = [keys, f.nbytes, probes, int(f.contains(hi, lo).sum())]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([v], pa.int64()) for v in row)], names=["shard", "keys", "bytes", "probes", "wrong"])

    held = stored(spark, path)
    bits = held.agg(F.min("bits")).first()[0] or BITS
    per = held.mapInArrow(run, "shard int, keys bigint, bytes bigint, probes bigint, wrong bigint").groupBy("shard").agg(F.count("*").alias("filters"), *[F.sum(c).alias(c) for c in ("keys", "bytes", "probes", "wrong")])
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("keys", "filters", "bytes", "probes", "wrong")]
    out = per.agg(*sums, (F.coalesce(F.max("filters"), F.lit(0)) * F.lit(2.0**-bits)).alias("bound"))
    # a key is asked of every filter of its shard
    return out.withColumn("rate", F.try_divide(F.col("wrong"), F.col("probes")))
