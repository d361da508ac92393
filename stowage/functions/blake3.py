"""The BLAKE3 hash, computed for many contents at once in numpy.

All 1,024-byte chunks of all contents go through the compression function side
by side, block after block; the chunk values of each content are then joined in
pairs, level by level, for all contents together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
COLUMNS_AND_DIAGONALS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK, ROUNDS = 64, 1024, 7
#: Bytes hashed at once.
BATCH_BYTES = 16 << 20


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """cv (n, 8) and message words (n, 16) to new chaining values (n, 8)."""
    n = len(cv)
    u = np.uint32
    v = [cv[:, i].copy() for i in range(8)] + [np.full(n, IV[i], u) for i in range(4)]
    v += [counter.astype(u), (counter >> 32).astype(u), length.astype(u), flags.astype(u)]
    m = [words[:, i] for i in range(16)]
    for r in range(ROUNDS):
        for k, (a, b, c, d) in enumerate(COLUMNS_AND_DIAGONALS):
            for x, (left, right) in ((m[2 * k], (16, 12)), (m[2 * k + 1], (8, 7))):
                v[a] = v[a] + v[b] + x
                v[d] = _turn(v[d] ^ v[a], left)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], right)
        if r < ROUNDS - 1:
            m = [m[i] for i in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1)


def digests(contents: list[bytes]) -> list[str]:
    """Lower-case hex of each content's 32-byte hash."""
    if not contents:
        return []
    sizes = np.array([len(c) for c in contents], np.int64)
    chunks = np.maximum(1, -(-sizes // CHUNK))
    base = np.cumsum(chunks) - chunks
    total = int(chunks.sum())
    room = np.zeros(total * CHUNK, np.uint8)
    for c, at in zip(contents, base):
        room[at * CHUNK : at * CHUNK + len(c)] = np.frombuffer(c, np.uint8)
    words = room.view("<u4").reshape(total, CHUNK // BLOCK, 16)
    owner = np.repeat(np.arange(len(contents)), chunks)
    counter = np.arange(total) - base[owner]
    left = np.minimum(sizes[owner] - counter * CHUNK, CHUNK)
    blocks = np.maximum(1, -(-left // BLOCK))
    alone = chunks[owner] == 1
    cv = np.tile(np.array(IV, np.uint32), (total, 1))
    for b in range(int(blocks.max())):
        at = np.flatnonzero(blocks > b)
        last = blocks[at] == b + 1
        flags = (b == 0) * CHUNK_START + last * CHUNK_END + (last & alone[at]) * ROOT
        cv[at] = compress(cv[at], words[at, b], counter[at], np.clip(left[at] - b * BLOCK, 0, BLOCK), flags)
    while len(owner) > len(contents):
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        count = np.bincount(owner, minlength=len(contents))
        first = np.flatnonzero((number % 2 == 0) & (number + 1 < count[owner]))
        pair = np.concatenate([cv[first], cv[first + 1]], axis=1)
        n = len(first)
        flags = PARENT + (count[owner[first]] == 2) * ROOT
        cv[first] = compress(np.tile(np.array(IV, np.uint32), (n, 1)), pair, np.zeros(n, np.int64), np.full(n, BLOCK), flags)
        stay = number % 2 == 0
        cv, owner = cv[stay], owner[stay]
    return [x.astype("<u4").tobytes().hex() for x in cv]


def digest(content: bytes) -> str:
    return digests([content])[0]


@F.pandas_udf(T.StringType())
def blake3(content: pd.Series) -> pd.Series:
    """BLAKE3 of a binary column, in hex; null stays null."""
    out: list[str | None] = [None] * len(content)
    held: list[int] = []
    size = 0

    def flush() -> None:
        for i, h in zip(held, digests([bytes(content.iloc[i]) for i in held])):
            out[i] = h
        held.clear()

    for i, c in enumerate(content):
        if c is None:
            continue
        held.append(i)
        size += len(c) + CHUNK
        if size >= BATCH_BYTES:
            flush()
            size = 0
    flush()
    return pd.Series(out, dtype=object)
