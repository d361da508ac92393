"""Evaluation texts leaking into training text, by an FM-index per shard.

The words of the items are the alphabet; every other word of a training text
ends a run. A shard is a block of texts: its run of symbols gets a suffix order,
a wavelet matrix over its Burrows-Wheeler transform and sampled positions. All
four-word phrases of all items are searched backward at once, and their
occurrences located. Whatever holds twelve words with one in six changed holds
one of its phrases unchanged. Occurrences are then verified exactly, all at once:
from each the alignment goes outward in a narrow band, for a run of at least
``RUN`` item words, beginning and ending with equal words, at most one in six of
them changed, missing or added; it ends where too many differ, so a phrase that
many items share costs a few steps for each. Spans are the union of all such runs,
and reach no farther.

Words are runs of letters, digits and marks (a Han or Kana character alone, the
latter with its voicing mark, is a word), compared after compatibility composition and case folding; apostrophes,
soft hyphens and joiners inside a word do not count; tags, entities, numbered notes
and link targets (with their titles) of up to ``MARKUP_CHARS`` are blanked.

Scale: texts are read once and never shuffled; only the items are broadcast, in
blocks of about ``ITEM_BLOCK_CHARS``. Each index is built once and searched for every
block; only beyond ``PASS_CHARS`` of items are the texts read again.

Defined results: null or empty texts and items with fewer than ``RUN`` words
have no cases; rows repeated under an id give one row; an empty table on either
side gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .fmindex import FMIndex
from .spans import merge_spans

RUN, PHRASE, ALLOWANCE = 12, 4, 6
CHUNK_CHARS, ITEM_BLOCK_CHARS = 3_000_000, 4_000_000
#: From here on words are not listed; words per index.
LONG_CHARS, INDEX_WORDS = 20_000_000, 1_000_000
#: Characters of items that one pass over the texts looks for (all its blocks lie on an
#: executor's disk, their words in memory).
PASS_CHARS = 128_000_000
#: A run holds a shorter one of fewer than SHORT_WORDS item words on either side of a
#: phrase: without two equal words at which to part it in two of RUN or more, of which one
#: would be a run, the edits of its middle alone would be too many (from 38 words on).
SHORT_WORDS = 40
#: Pairs of a phrase and an item, and cells of the alignments, worked on at once.
PAIRS, BATCH_CELLS = 2_000_000, 4_000_000
FAR = 1 << 20

#: Markup up to MARKUP_CHARS long: beyond, a lone ``<`` in prose would blank what follows it.
MARKUP_CHARS = 2_000
_TARGET = r"\(\s?(?:[^()\s]|\([^()\s]{0,200}\)){1,%d}(?:\s{1,9}\"[^\"]{0,300}\")?\s?\)" % MARKUP_CHARS
_MARKUP = rf"</?[A-Za-z!][^<>]{{0,{MARKUP_CHARS}}}>|&(?:#\d{{1,7}}|#x[0-9a-fA-F]{{1,6}}|[A-Za-z]{{2,8}});|\[\d{{1,4}}\]|(?<=\]){_TARGET}"
_INNER = "'\u2019\u02bc\u00ad\u200b\u200c\u200d\u2060\ufeff"
_WORD = rf"\p{{Han}}|[\p{{Hiragana}}\p{{Katakana}}][\u3099\u309a\uff9e\uff9f]?|[\p{{L}}\p{{N}}][[\p{{L}}\p{{N}}\p{{M}}{_INNER}]--[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]]*"
_DROP = {ord(c): None for c in _INNER}


def plain(word: str) -> str:
    w = word.translate(_DROP)
    return w.lower() if w.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", w).casefold())


class Words:
    """Cuts texts into words."""

    def __init__(self):
        import regex

        self._markup, self._word = regex.compile(_MARKUP), regex.compile(_WORD, regex.V1)

    def blanked(self, text: str) -> str:
        if "<" in text or "&" in text or "]" in text:
            text = self._markup.sub(lambda m: " " * len(m.group()), text)
        return text

    def cut(self, text: str) -> list[str]:
        return self._word.findall(self.blanked(text))

    def numbers(self, text: str, known: Callable[[str], int]) -> np.ndarray:
        """Each word's number; long texts never hold all their words as strings."""
        text = self.blanked(text)
        words = self._word.findall(text) if len(text) < LONG_CHARS else (m.group() for m in self._word.finditer(text))
        return np.fromiter(map(known, words), np.int32)

    def offsets(self, text: str, wanted: set[int]) -> dict[int, tuple[int, int]]:
        """Where the wanted words (by number) stand."""
        return {n: m.span() for n, m in enumerate(self._word.finditer(self.blanked(text))) if n in wanted}


class Items:
    """A block of test items as symbols: 0 ends a shard, 1 is any other word. Words are
    numbered by ``vocabulary``, which blocks share; phrases and their uses are arrays."""

    def __init__(self, rows: list[tuple[int, str | None]], vocabulary: dict[str, int] | None = None):
        cut = Words().cut
        self.vocabulary = {} if vocabulary is None else vocabulary
        self.ids, words = [], []
        for item, text in rows:
            w = [plain(x) for x in cut(text or "")]
            if len(w) >= RUN:
                self.ids.append(item)
                words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 2) for x in w], np.int32))
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(words) if words else np.empty(0, np.int32)
        item = np.repeat(np.arange(len(words)), self.sizes)
        k = np.arange(len(self.flat)) - self.begin[item] if words else np.empty(0, np.int64)
        at = np.flatnonzero(k + PHRASE <= self.sizes[item]) if words else np.empty(0, np.int64)
        number = self.flat.astype(np.int64)
        for half in (1, 2):  # two words, then two pairs: PHRASE is four
            pair = number[at] << 32 | number[np.minimum(at + half, len(number) - 1)] if half == 2 else number[:-1] << 32 | number[1:]
            number = np.unique(pair, return_inverse=True)[1].astype(np.int64) if len(pair) else np.empty(0, np.int64)
        order = np.argsort(number, kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0][: len(order)])
        self.phrases = self.flat[at[order[head]][:, None] + np.arange(PHRASE)] if len(head) else np.empty((0, PHRASE), np.int32)
        #: uses of phrase p: entries first[p]:first[p + 1], each an item and a place in it
        self.first = np.r_[head, len(order)].astype(np.int64)
        self.item, self.place = item[at[order]].astype(np.int32), k[at[order]].astype(np.int32)

    @property
    def words(self) -> list[np.ndarray]:
        return [self.flat[a : a + n] for a, n in zip(self.begin.tolist(), self.sizes.tolist())]


def _merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges; such as only touch stay apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _beyond(item: np.ndarray, i0: np.ndarray, left: np.ndarray, text: np.ndarray, t0: np.ndarray, room: np.ndarray, step: int, reach: int, budget: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Aligns what lies beyond many places at once: item words i0, i0 + step, ... (``left``
    of them) with text words t0, t0 + step, ... (``room``). Per number y of item words:
    (y, rows, drift, cost), the least edits of the first y item words against y + drift
    text words where the last two are equal (``FAR`` otherwise). A row ends where no cell
    is within its ``budget`` of edits, so the band need be no wider than that."""
    slack = int(budget.max(initial=0))
    drift = np.arange(-slack, slack + 1)
    rows = np.arange(len(i0))
    cost = np.repeat(np.where(drift < 0, FAR, drift)[None, :], len(i0), 0).astype(np.int32)
    for y in range(1, reach + 1):
        live = (left[rows] >= y) & (cost.min(axis=1) <= budget[rows])
        rows, cost = rows[live], cost[live]
        if not len(rows):
            return
        n = y + drift[None, :]
        inside = (n >= 1) & (n <= room[rows][:, None])
        at = t0[rows][:, None] + step * (n - 1)
        same = inside & (text[np.where(inside, at, 0)] == item[i0[rows] + step * (y - 1)][:, None])
        hit = np.where(same, cost, FAR)
        yield y, rows, drift, hit
        best = np.where(inside, cost + ~same, FAR)
        best[:, :-1] = np.minimum(best[:, :-1], cost[:, 1:] + 1)
        best = np.where(n[0] >= 0, best, FAR)
        cost = np.minimum.accumulate(best - drift, axis=1) + drift
        cost = np.where(n <= room[rows][:, None], cost, FAR).astype(np.int32)


def _sides(items: Items, item: np.ndarray, k: np.ndarray, size: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, j: np.ndarray, cap: int | None) -> tuple:
    """The alignments left and right of equal stretches (item words k.., text words j..,
    ``size`` long; the texts are text[low:high]), within ``cap`` item words of them."""
    m = items.sizes[item]
    before, after = k, m - k - size
    if cap is not None:
        before, after = np.minimum(before, cap), np.minimum(after, cap)
    budget = (before + size + after) // ALLOWANCE
    reach = int(max(before.max(initial=0), after.max(initial=0)))
    base = items.begin[item]
    left = list(_beyond(items.flat, base + k - 1, before, text, j - 1, j - low, -1, reach, budget))
    budget = (_gains(left, len(j), reach)[:, 0] + size + after) // ALLOWANCE
    right = list(_beyond(items.flat, base + k + size, after, text, j + size, high - j - size, 1, reach, budget))
    return left, right, reach


def _gains(side: list, count: int, reach: int) -> np.ndarray:
    """gain[row, z]: the most that z or more item words beyond add to (words - edits *
    ALLOWANCE); they end with an equal word, or are none."""
    gain = np.full((count, reach + 1), -FAR, np.int32)
    gain[:, 0] = 0
    for y, rows, _, hit in side:
        gain[rows, y] = y - ALLOWANCE * hit.min(axis=1)
    return np.maximum.accumulate(gain[:, ::-1], axis=1)[:, ::-1]


def _farthest(side: list, other: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """The most text words beyond that belong to a run of ``least`` item words, -1 if there
    is no run; ``other``: the gains of the other side."""
    last = other.shape[1] - 1

    def with_other(y: int, rows: np.ndarray) -> np.ndarray:
        need = np.maximum(0, least - size[rows] - y)
        return np.where(need <= last, other[rows, np.minimum(need, last)], -FAR) + size[rows]

    everyone = np.arange(len(size))
    out = np.where(with_other(0, everyone) >= 0, 0, -1)
    for y, rows, drift, hit in side:
        ok = (hit < FAR) & (with_other(y, rows)[:, None] + y - ALLOWANCE * hit >= 0)
        out[rows] = np.maximum(out[rows], np.where(ok, y + drift, -1).max(axis=1))
    return out


def _runs(items: Items, item: np.ndarray, k: np.ndarray, size: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, j: np.ndarray, cap: int | None = None, least: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Per equal stretch the text range of all runs that hold it; begin = end for none.

    A run is RUN or more successive item words aligned with the text, the first and the
    last with equal words, and at most one edit (a word changed, missing or added) per
    ALLOWANCE of them. The two sides of a stretch are independent but for the sum of their
    lengths and edits; all runs with one stretch overlap in it, so their union is one range.
    """
    begin, end = j.copy(), j.copy()
    m = items.sizes[item] if cap is None else np.minimum(items.sizes[item], 2 * cap + size)
    order = np.argsort(m, kind="stable")
    cells = np.cumsum(np.maximum(1, m[order]) * (2 * (m[order] // ALLOWANCE) + 1))
    for part in np.split(order, np.flatnonzero(np.diff(cells // BATCH_CELLS)) + 1):
        x = [v[part] for v in (item, k, size)]
        left, right, reach = _sides(items, *x, text, low[part], high[part], j[part], cap)
        gains = [_gains(s, len(part), reach) for s in (left, right)]
        a, b = _farthest(left, gains[1], size[part], least), _farthest(right, gains[0], size[part], least)
        ok = (a >= 0) & (b >= 0)
        begin[part[ok]] = j[part[ok]] - a[ok]
        end[part[ok]] = j[part[ok]] + size[part[ok]] + b[ok]
    return begin, end


def run_ranges(item: np.ndarray, text: np.ndarray, whole: bool = True) -> list[tuple[int, int]]:
    """The union of the text ranges of all runs of one item in one text (word numbers);
    unless ``whole``, of some, if there is any."""
    item, text = np.asarray(item), np.asarray(text)
    if min(len(item), len(text)) < PHRASE:
        return []
    one = Items([])
    one.sizes, one.begin, one.flat = np.array([len(item)]), np.zeros(1, np.int64), item
    same = item[:, None] == text[None, :]
    k, j = np.nonzero(np.logical_and.reduce([same[i : len(item) - PHRASE + 1 + i, i : len(text) - PHRASE + 1 + i] for i in range(PHRASE)]))
    zero = np.zeros(len(k), np.int64)
    _, _, begin, end = _verified(one, zero, k, j, text, np.zeros(1, np.int64), np.array([len(text)]), whole)
    return _merged(zip(begin.tolist(), end.tolist()))


def _stretches(s: np.ndarray, words: int, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    """(begin, words) of a text; a long one in stretches, of which one holds any run."""
    step = max(1, words - overlap)
    for a in range(0, max(1, len(s) - overlap), step):
        yield a, s[a : a + words]


def _shard(texts: list[str], vocabulary: dict[str, int], blocks: Callable[[], Iterable[Items]], longest: int, cut: Words, seen: dict[str, int], index_words: int = INDEX_WORDS, whole: bool = True) -> Iterator[tuple[int, int, int, int]]:
    """(text number, item id, first word, word after the last) of all leaks in a block of
    texts: one index per ``index_words`` words, searched for every block of items."""

    def known(word: str) -> int:
        n = seen.get(word)
        if n is None:
            n = seen[word] = vocabulary.get(plain(word), 1)
        return n

    overlap = longest + 2 * (longest // ALLOWANCE + 1)
    held: list[tuple[int, int, np.ndarray]] = []
    count = 0
    for n, t in enumerate(texts):
        for a, s in _stretches(cut.numbers(t, known), max(index_words, 2 * overlap + 2), overlap):
            held.append((n, a, s))
            count += len(s)
            if count >= index_words:
                yield from _search(held, len(vocabulary) + 2, blocks, whole)
                held, count = [], 0
    yield from _search(held, len(vocabulary) + 2, blocks, whole)


def _search(held: list[tuple[int, int, np.ndarray]], sigma: int, blocks: Callable[[], Iterable[Items]], whole: bool) -> Iterator[tuple[int, int, int, int]]:
    """All leaks in stretches (text number, begin, word numbers), by one index."""
    sizes = np.array([len(s) for _, _, s in held], np.int64)
    low = np.cumsum(sizes) - sizes
    flat = np.concatenate([s for _, _, s in held]) if held else np.empty(0, np.int32)
    # runs of other words shrink to one symbol; each stretch ends with one
    new = np.zeros(len(flat), bool)
    new[low[sizes > 0]] = True
    keep = np.flatnonzero((flat != 1) | np.r_[True, flat[:-1] != 1][: len(flat)] | new)
    if not len(keep):
        return
    of = np.repeat(np.arange(len(held)), sizes)[keep]
    ends = np.flatnonzero(np.diff(of, append=-1)) + 1
    symbols = np.r_[np.insert(flat[keep], ends, 1), 0].astype(np.int64)
    place = np.insert(keep, ends, -1)
    index = FMIndex(symbols, sigma)
    there = np.diff(index.first) > 0
    number, begin = np.array([n for n, _, _ in held]), np.array([a for _, a, _ in held])
    for items in blocks():
        asked = np.flatnonzero(there[items.phrases].all(axis=1)) if len(items.phrases) else np.empty(0, np.int64)
        if not len(asked):
            continue
        first, last = index.search(items.phrases[asked].astype(np.int64))
        counts = last - first
        phrase = np.repeat(asked, counts)
        if not len(phrase):
            continue
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        j = place[index.locate(rows)]
        order = np.argsort(j, kind="stable")
        j, phrase = j[order], phrase[order]
        uses = items.first[phrase + 1] - items.first[phrase]
        # a phrase of many items stands for many pairs: so many at once
        for part in np.split(np.arange(len(j)), np.flatnonzero(np.diff(np.cumsum(uses) // PAIRS)) + 1):
            n = uses[part]
            use = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.first[phrase[part]], n)
            at = np.repeat(j[part], n)
            found = _verified(items, items.item[use].astype(np.int64), items.place[use].astype(np.int64), at, flat, low, sizes, whole)
            for s, i, a, b in zip(*(x.tolist() for x in found)):
                yield int(number[s]), items.ids[i], int(begin[s]) + a - int(low[s]), int(begin[s]) + b - int(low[s])


def _equal_stretches(item: np.ndarray, k: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, k, j, size) of the maximal equal stretches that phrases at (k, j) make up."""
    d = j - k
    most, least = int(k.max()) + 1, int(d.min())
    wide = int(d.max()) - least + 1
    if int(item.max() + 1) * wide * most < 1 << 62:
        key = np.sort((item * wide + (d - least)) * most + k)
        line, k = np.divmod(key, most)
        item, d = np.divmod(line, wide)
        d += least
    else:
        order = np.lexsort((k, d, item))
        item, k, d = item[order], k[order], d[order]
        line = np.cumsum(np.r_[True, (np.diff(item) != 0) | (np.diff(d) != 0)])
    at = np.flatnonzero(np.r_[True, (np.diff(line) != 0) | (np.diff(k) != 1)])
    return item[at], k[at], (d + k)[at], np.diff(np.r_[at, len(k)]) + PHRASE - 1


def _verified(items: Items, item: np.ndarray, k: np.ndarray, j: np.ndarray, text: np.ndarray, low: np.ndarray, sizes: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, item, begin, end) of the runs that the phrases at (k, j) are part of;
    text number n is text[low[n]:][:sizes[n]].

    A run may be taken to follow an equal stretch to its ends, except for runs that end
    beside it, with a word that stands twice: those take no more words than they have edits
    (two at most, as no longer run gains by it) and start from a phrase inside."""
    if not len(k):
        return item, item, j, j
    item, k, j, size = _equal_stretches(item, k, j)
    of = np.searchsorted(low, j, side="right") - 1
    begin, end = j.copy(), j.copy()
    pair = np.unique(of * len(items.sizes) + item, return_inverse=True)[1]
    leaked = np.zeros(pair.max() + 1, bool)

    def widen(rows: np.ndarray, first: np.ndarray, n: np.ndarray, cap: int | None, least: int = RUN) -> np.ndarray:
        """Ranges of the runs through ``n`` words from word ``first`` of stretches on."""
        a, b = _runs(items, item[rows], k[rows] + first, n, text, low[of[rows]], (low + sizes)[of[rows]], j[rows] + first, cap, least)
        ok = b > a
        if least == RUN:
            np.minimum.at(begin, rows[ok], a[ok])
            np.maximum.at(end, rows[ok], b[ok])
        return rows[ok]

    def phrases(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = size[rows] - PHRASE + 1
        which = np.repeat(rows, n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), np.full(len(which), PHRASE)

    sure = size >= RUN
    end[sure] += size[sure]
    leaked[pair[sure]] = True
    # no run without one along the whole stretch that is shorter by its edits at most
    open_ = np.flatnonzero(~leaked[pair])
    near = widen(open_, np.zeros(len(open_), np.int64), size[open_], SHORT_WORDS, RUN - RUN // ALLOWANCE)
    leaked[pair[widen(*phrases(near), SHORT_WORDS)]] = True
    if whole:
        rows = np.flatnonzero(leaked[pair])
        short = np.full(len(rows), PHRASE)
        widen(rows, np.zeros(len(rows), np.int64), short, None)
        more = rows[size[rows] > PHRASE]
        widen(more, size[more] - PHRASE, short[: len(more)], None)
        edge = (size[rows] < RUN + 2) & ((begin[rows] > j[rows] - 2) | (end[rows] < j[rows] + size[rows] + 2))
        widen(*phrases(rows[edge]), None)
    hit = end > begin
    return of[hit], item[hit], begin[hit], end[hit]


def _find(vocabulary, held: list, longest: int, chunk_chars: int, index_words: int, whole: bool):
    def blocks() -> Iterator[Items]:
        for b in held:
            # one block stays in memory; of several, one at a time
            yield b.value if len(held) == 1 else b.load_from_path(b._path) if getattr(b, "_path", None) else b.value

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = Words(), {}

        def block(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            leaks_of: dict[int, dict[int, list[tuple[int, int]]]] = {}
            for n, i, a, b in _shard(texts, vocabulary.value, blocks, longest, cut, seen, index_words, whole):
                leaks_of.setdefault(n, {}).setdefault(i, []).append((a, b))
            rows = []
            for n, found in leaks_of.items():
                if not whole:
                    rows += [(ids[n], i, None, None) for i in found]
                    continue
                merged = [(i, a, b) for i, x in found.items() for a, b in _merged(x)]
                place = cut.offsets(texts[n], {w for _, a, b in merged for w in (a, b - 1)})
                rows += [(ids[n], i, place[a][0], place[b - 1][1]) for i, a, b in merged]
            if len(seen) > 1_000_000:
                seen.clear()
            cols = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "item", "a", "b"])

        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                chars += len(t)
                if chars >= chunk_chars:
                    yield block(ids, texts)
                    ids, texts, chars = [], [], 0
        if ids:
            yield block(ids, texts)

    return run


def _parts(tests: DataFrame, chars: int, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of about ``most`` characters, one at a time."""
    parts = max(1, -(-chars // most))
    for n in range(parts):
        part = tests if parts == 1 else tests.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == n)
        yield [(r.i, r.t) for r in part.orderBy("i").collect()]


def leak_spans(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, chunk_chars: int = CHUNK_CHARS, index_words: int = INDEX_WORDS, whole: bool = True) -> DataFrame:
    """(doc, item, a, b): where each item leaks into each text, in code points; unless
    ``whole``, only which items leak, which is quicker (a and b are null then)."""
    spark = docs.sparkSession
    shape = "doc bigint, item bigint, a bigint, b bigint"
    rows = docs.where(F.col(key).isNotNull() & (F.char_length(text) > 0)).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    tests = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).dropDuplicates()
    tests = cut(tests.withColumn("n", F.char_length("t")))
    chars = tests.agg(F.sum("n")).first()[0] or 0
    out = None
    passes = -(-chars // PASS_CHARS)
    for n in range(passes):
        mine = tests if passes == 1 else tests.where(F.pmod(F.xxhash64("i", F.lit(5)), F.lit(passes)) == n)
        vocabulary: dict[str, int] = {}
        held, longest = [], 0
        for part in _parts(mine, -(-chars // passes), ITEM_BLOCK_CHARS):
            block = Items(part, vocabulary)
            longest = max(longest, int(block.sizes.max(initial=0)))
            block.vocabulary = None
            if len(block.phrases):
                held.append(spark.sparkContext.broadcast(block))
        if not held:
            continue
        one = rows.mapInArrow(_find(spark.sparkContext.broadcast(vocabulary), held, longest, chunk_chars, index_words, whole), shape)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], shape) if out is None else out


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, chunk_chars: int = CHUNK_CHARS, index_words: int = INDEX_WORDS) -> DataFrame:
    """One row per document and item that leaked into it."""
    found = leak_spans(docs, key, text, items, item_key, item_text, chunk_chars, index_words, whole=False)
    return found.select(F.col("doc").alias(key), F.col("item").alias(item_key)).dropDuplicates()


def removal_spans(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, chunk_chars: int = CHUNK_CHARS, index_words: int = INDEX_WORDS) -> DataFrame:
    """(key, span_start, span_end): the leaked passages of each text, merged."""
    found = leak_spans(docs, key, text, items, item_key, item_text, chunk_chars, index_words).select("doc", "a", "b")
    return merge_spans(found, "doc", "a", "b").select(F.col("doc").alias(key), F.col("a").alias("span_start"), F.col("b").alias("span_end"))
