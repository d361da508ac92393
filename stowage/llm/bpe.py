"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern. The distinct new words of
a batch are encoded together in numpy: the symbols of all words lie in one flat
array; in each merge round the keys of all adjacent pairs are looked up by
binary search over the sorted pair keys, every word merges all occurrences of
its lowest-ranked pair, and finished words leave the array. Encoded words are
kept in a bounded store per worker; a document is then one gather.

Defined results: null and empty texts give an empty list; strings that look
like special tokens are ordinary text; a text of any length is encoded whole (in
pieces that join exactly, where it is long);
repeated rows are encoded each; an empty input gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: The pattern that splits text before the merges (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that the regex library's newer Unicode tables count as letters or
#: numbers, but the vocabulary's libraries (Unicode 16) do not (fixed values).
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
    "1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 "
    "1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
#: Words kept per worker; characters of text encoded at once.
STORE_WORDS, CHUNK_CHARS = 400_000, 4_000_000


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1,
    else the next free code point from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Encoder:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.span = len(ids)
        keys = left * self.span + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)  # by rank
        self.of_byte = np.array([ids[c] for c in _byte_letters()], np.int32)
        newer = "".join("-".join(f"\\U{int(x, 16):08x}" for x in part.split("-")) for part in NEWER.split())
        letters, numbers = f"[\\p{{L}}--[{newer}]]", f"[\\p{{N}}--[{newer}]]"
        strict = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}+", letters + "+").replace(r"\p{N}+", numbers + "+")
        self.newer = regex.compile(f"[{newer}]").search
        self.plain, self.strict = regex.compile(PATTERN).findall, regex.compile(strict, regex.V1).findall
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and the ids of all words one after the other."""
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        done_sym, done_word = [], []
        never = len(self.keys)
        while len(sym):
            rank = np.full(len(sym), never, np.int64)
            if len(sym) > 1:
                key = sym[:-1].astype(np.int64) * self.span + sym[1:]
                at = np.minimum(np.searchsorted(self.keys, key), never - 1)
                hit = (self.keys[at] == key) & (word[:-1] == word[1:])
                rank[:-1][hit] = self.ranks[at[hit]]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lens = np.diff(np.r_[heads, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, heads), lens)
            live = least < never
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, least = sym[live], word[live], rank[live], least[live]
                if not len(sym):
                    break
            pick = rank == least
            # of touching equal pairs (aaa) every second one, from the left
            run = pick & np.r_[False, pick[:-1]]
            if run.any():
                pos = np.arange(len(sym))
                begin = np.maximum.accumulate(np.where(pick & ~run, pos, 0))
                pick &= (pos - begin) % 2 == 0
            sym = sym.copy()
            sym[pick] = self.made[rank[pick]]
            stay = ~np.r_[False, pick[:-1]]
            sym, word = sym[stay], word[stay]
        if not done_sym:
            return np.zeros(len(raw), np.int64), np.empty(0, np.int32)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.bincount(word, minlength=len(raw)).astype(np.int64), sym[order]

    def split(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or not self.newer(text) else self.strict(text)

    def _learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.index]
        if not new:
            return
        lens, flat = self.encode_words(new)
        base = len(self.starts) - 1
        self.index.update(zip(new, range(base, base + len(new))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lens)])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (len + 1) and the ids of all texts one after the other."""
        if len(self.index) > STORE_WORDS:
            self.reset()
        split = [self.split(t) if t else [] for t in texts]
        self._learn(set().union(*split))
        get = self.index.__getitem__
        counts = np.fromiter(map(len, split), np.int64, len(split))
        w = np.fromiter((i for s in split for i in map(get, s)), np.int64, int(counts.sum()))
        begin, lens = self.starts[w], self.starts[w + 1] - self.starts[w]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(begin - (ends - lens), lens) + np.arange(total)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return bounds, ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(text: str, size: int) -> Iterator[str]:
    """A long text in pieces whose encodings join to that of the whole: no word of
    the pattern holds a space after another character, so cuts go before one that
    follows a character which is no white space."""
    a = 0
    while len(text) - a > size:
        b = text.find(" ", a + size)
        while b > 0 and text[b - 1].isspace():
            b = text.find(" ", b + 1)
        if b < 0:
            break
        yield text[a:b]
        a = b
    yield text[a:]


def _chunks(texts: list[str | None], chunk_chars: int) -> Iterator[tuple[int, int]]:
    a, chars = 0, 0
    for i, t in enumerate(texts):
        if len(t or "") > chunk_chars and a < i:  # a long text stands alone
            yield a, i
            a, chars = i, 0
        chars += len(t or "")
        if chars >= chunk_chars:
            yield a, i + 1
            a, chars = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(key, ids): the ids of ``text``, without special tokens, row by row."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts, chunk_chars):
                if b - a == 1 and len(texts[a] or "") > chunk_chars:
                    ids = np.concatenate([e.encode([x])[1] for x in pieces(texts[a], chunk_chars)])
                    bounds = np.array([0, len(ids)])
                else:
                    bounds, ids = e.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
