"""Content-defined chunking: cut points follow the bytes, not the offsets.

The rolling hash is a gear hash: shifted left by one, plus a table value per
byte. A cut test looks at the low ``bits`` bits only, which depend on the last
``bits`` bytes; so the hash at all positions of a content is ``bits`` shifted
additions over the whole array. Only the first positions after a minimum length
start from an empty hash and are summed apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN, AVERAGE, MAX = 2_048, 8_192, 65_536
# Seed, multiplier and increment of the gear table's generator.
SEED, MULTIPLIER, INCREMENT = 0x123456789ABCDEF0, 6364136223846793005, 1442695040888963407


def gear_table() -> np.ndarray:
    out, x = np.empty(256, np.uint64), SEED
    for i in range(256):
        x = (x * MULTIPLIER + INCREMENT) & 0xFFFFFFFFFFFFFFFF
        out[i] = x
    return out


GEAR = gear_table()


def cut_points(data: bytes, low: int = MIN, average: int = AVERAGE, high: int = MAX) -> list[int]:
    """End offsets of the chunks of ``data``; none for empty data."""
    if not (64 <= low < average < high):
        raise ValueError("sizes must satisfy 64 <= min < average < max")
    n = len(data)
    if n == 0:
        return []
    bits = round(np.log2(average))
    strict, loose = np.uint64((1 << bits) - 1), np.uint64((1 << (bits - 2)) - 1)
    table = GEAR[np.frombuffer(data, np.uint8)]
    rolling = table.copy()
    for k in range(1, min(bits, n)):
        rolling[k:] += table[:-k] << np.uint64(k)
    hits_strict = np.flatnonzero((rolling & strict) == 0)
    hits_loose = np.flatnonzero((rolling & loose) == 0)
    out, start = [], 0
    while start < n:
        if n - start <= low:
            out.append(n)
            break
        first = start + low
        middle, last = min(start + average, n), min(start + high, n)
        cut = None
        h = np.uint64(0)
        # the hash begins empty at ``first``
        warm = min(first + bits - 1, last)
        with np.errstate(over="ignore"):
            for p in range(first, warm):
                h = (h << np.uint64(1)) + table[p]
                if h & (strict if p < middle else loose) == 0:
                    cut = p + 1
                    break
        if cut is None:
            for hits, a, b in ((hits_strict, warm, middle), (hits_loose, max(warm, middle), last)):
                i = np.searchsorted(hits, a)
                if a < b and i < len(hits) and hits[i] < b:
                    cut = int(hits[i]) + 1
                    break
        start = last if cut is None else cut
        out.append(start)
    return out


def chunks(df: DataFrame, key: str, content: str, low: int = MIN, average: int = AVERAGE, high: int = MAX) -> DataFrame:
    """(key, idx, offset, length, digest) of every chunk, in order; null content has
    none. The digest is SHA-256 in hex."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows: list[tuple] = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = 0
                for i, b in enumerate(cut_points(data or b"", low, average, high)):
                    rows.append((k, i, a, b - a, hashlib.sha256(data[a:b]).hexdigest()))
                    a = b
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[key, "idx", "offset", "length", "digest"])

    return df.select(key, F.col(content).cast("binary").alias("_c")).mapInArrow(run, f"`{key}` {kind}, idx int, offset bigint, length int, digest string")


def chunk_stats(parts: DataFrame, *by: str) -> DataFrame:
    """Number, total, least, greatest and mean length, and the spread (max - min) / 4,
    which is 0 for fewer than two chunks."""
    n = F.count("*")
    return parts.groupBy(*by).agg(
        n.alias("chunks"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce(F.min("length"), F.lit(0)).alias("least"),
        F.coalesce(F.max("length"), F.lit(0)).alias("greatest"),
        F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"),
        F.when(n <= 1, F.lit(0.0)).otherwise((F.max("length") - F.min("length")) / F.lit(4.0)).alias("spread"),
    )
