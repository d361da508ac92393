"""HMAC-SHA256 of a column, in built-in expressions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digests import col

BLOCK, VERSION = 64, 1


def hmac_sha256(message: Column | str, secret: bytes) -> Column:
    """Lower-case hex. The padded keys are computed once, on the driver."""
    if not secret:
        raise ValueError("the secret is empty")
    key = hashlib.sha256(secret).digest() if len(secret) > BLOCK else secret
    key = key.ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, col(message).cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def verify(message: Column | str, signature: Column | str, version: Column | str, secret: bytes) -> Column:
    """Only version 1; digests of both signatures are compared, not the texts."""
    expected = F.sha2(hmac_sha256(message, secret), 256)
    return (col(version) == VERSION) & F.coalesce(F.sha2(F.lower(col(signature)), 256) == expected, F.lit(False))
