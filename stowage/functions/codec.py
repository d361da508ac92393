"""Compressed or not: sniffing magic numbers, deciding, packing and unpacking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .digests import col

# Limits, marker bytes, and the first bytes of compressed formats
# (gzip, zstd, bzip2, xz, zip, 7z, PNG, JPEG, Matroska), then those at an offset.
MIN_SIZE, MAX_RATIO, LEVEL = 512, 0.95, 3
PLAIN, ZSTD = b"\x00", b"\x01"
MAGIC = ("1f8b", "28b52ffd", "425a68", "fd377a58", "504b0304", "377abcaf", "89504e47", "ffd8ff", "1a45dfa3")
MAGIC_AT = ((8, "57454250"), (4, "66747970"))


def compressed(data: Column | str) -> Column:
    """Whether binary data begins like a compressed format; under 4 bytes never."""
    data = col(data)
    head = F.lower(F.hex(F.substring(data, 1, 12)))
    hit = F.lit(False)
    for m in MAGIC:
        hit = hit | F.startswith(head, F.lit(m))
    for at, m in MAGIC_AT:
        hit = hit | (F.substring(head, 2 * at + 1, len(m)) == m)
    return F.when(F.octet_length(data) < 4, F.lit(False)).otherwise(hit)


def worth_trying(data: Column | str) -> Column:
    return (F.octet_length(col(data)) >= MIN_SIZE) & ~compressed(data)


def wrap(level: int = LEVEL):
    """A function of binary data and ``worth_trying``: marker byte and content."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, worth: pd.Series) -> pd.Series:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)

        def one(d, w):
            if d is None:
                return None
            packed = packer.compress(bytes(d)) if w else None
            return PLAIN + bytes(d) if packed is None or len(packed) > MAX_RATIO * len(d) else ZSTD + packed

        return pd.Series([one(d, w) for d, w in zip(data, worth)])

    return run


def pack(data: Column | str, level: int = LEVEL) -> Column:
    return wrap(level)(col(data), F.coalesce(worth_trying(data), F.lit(False)))


@F.pandas_udf(T.BinaryType())
def unpack(data: pd.Series) -> pd.Series:
    """The content of packed data; empty data or an unknown marker is an error."""
    import zstandard

    opener = zstandard.ZstdDecompressor()

    def one(d):
        if d is None:
            return None
        d = bytes(d)
        if d[:1] == PLAIN:
            return d[1:]
        if d[:1] == ZSTD:
            return opener.decompressobj().decompress(d[1:])
        raise ValueError("empty data or unknown marker")

    return pd.Series([one(d) for d in data])


def packed_format(data: Column | str) -> Column:
    """0 plain, 1 zstd, from the marker byte; else null."""
    mark = F.hex(F.substring(col(data), 1, 1))
    return F.when(mark == "00", F.lit(0)).when(mark == "01", F.lit(1))
