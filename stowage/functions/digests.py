"""Digests (``algorithm:hex``), paths and host names in canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that is trimmed, the algorithms, the default one.
WHITE_SPACE = " \t\n\r\f\v"
ALGORITHMS = ("blake3", "sha256")
DEFAULT_ALGORITHM = "blake3"
WELL_FORMED = "^(blake3|sha256):[0-9a-f]{64}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def digest_key(digest: Column | str, algorithm: Column | str | None = None) -> Column:
    """``algorithm:hex`` in lower case. A prefix in the digest wins over the
    algorithm column; without either the algorithm is blake3. Null stays null."""
    text = F.lower(trimmed(digest))
    if algorithm is None:
        prefix: Column = F.lit(DEFAULT_ALGORITHM)
    else:
        named = F.lower(trimmed(algorithm))
        prefix = F.when(named.isNull() | (named == ""), F.lit(DEFAULT_ALGORITHM)).otherwise(named)
    return F.when(F.contains(text, F.lit(":")), text).otherwise(F.concat(prefix, F.lit(":"), text))


def is_well_formed(key: Column) -> Column:
    return F.coalesce(key.rlike(WELL_FORMED), F.lit(False))


def format_digest(algorithm: Column | str, hexdigest: Column | str) -> Column:
    return F.concat_ws(":", F.lower(col(algorithm)), F.lower(col(hexdigest)))


def parse_digest(text: Column | str) -> Column:
    """struct(algorithm, hex), or null unless there is exactly one colon, a known
    algorithm and 64 hex digits (either case)."""
    text = col(text)
    ok = text.rlike("^(blake3|sha256):[0-9a-fA-F]{64}$")
    parts = F.split(text, ":")
    return F.when(ok, F.struct(parts[0].alias("algorithm"), F.lower(parts[1]).alias("hex")))


def shard(hexdigest: Column | str) -> Column:
    """The first byte of a digest, as two hex characters."""
    return F.substring(col(hexdigest), 1, 2)


def blob_path(algorithm: Column | str, hexdigest: Column | str, prefix: str = "") -> Column:
    parts = [F.lit(prefix)] if prefix else []
    return F.concat_ws("/", *parts, col(algorithm), shard(hexdigest), col(hexdigest))


def manifest_name(key: Column | str) -> Column:
    """``<hex of the key>.json``."""
    return F.concat(F.lower(F.hex(col(key))), F.lit(".json"))


def manifest_key(name: Column | str) -> Column:
    """Inverse of :func:`manifest_name`; null for other names."""
    body = F.regexp_extract(col(name), r"^((?:[0-9a-fA-F]{2})+)\.json$", 1)
    return F.when(body != "", F.unhex(body).cast("string"))


def normal_path(path: Column | str) -> Column:
    """Trimmed, ``\\`` read as ``/``, empty and ``.`` segments dropped, ``..``
    resolved (at the top it goes nowhere). A path without segments is null."""
    text = F.translate(trimmed(path), "\\", "/")
    parts = F.filter(F.split(text, "/"), lambda x: (x != "") & (x != "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    parts = F.when(F.contains(text, F.lit("..")), resolved).otherwise(parts)
    joined = F.when(text.rlike(r"//|(^|/)\.|^/|/$"), F.array_join(parts, "/")).otherwise(text)
    return F.when(joined != "", joined)


def directory(path: Column | str) -> Column:
    """Everything before the last ``/``; empty at the top."""
    return F.regexp_extract(col(path), "^(.*)/[^/]*$", 1)


def host(name: Column | str) -> Column:
    """Trimmed, lower case, up to the first dot; null, blank and ``unknown`` are null."""
    text = F.substring_index(F.lower(trimmed(name)), ".", 1)
    return F.when((text != "") & (text != "unknown"), text)
