"""Long exact spans shared between records, by difference-cover anchors.

Windows of ``ANCHOR`` characters are hashed only at positions whose remainder
modulo ``PERIOD`` lies in a difference cover. For any two equal runs of at least
``LENGTH = PERIOD + ANCHOR - 1`` characters some shift puts both at cover
positions, so they share an aligned anchor, wherever the runs stand in their
texts, and then extends:

1. anchors, pre-aggregated per block of texts, then by hash: which anchors occur
   in more than one record. The cover is perfect: runs whose distance is no
   multiple of the period share one anchor per period, at two different
   remainders; all others share those of every remainder, of which the first is
   enough. So an anchor found at one remainder only is left out unless it is the
   first, and copies cost no more anchors than shifted passages;
2. the places of shared anchors, by a join with their hashes, and the texts that
   hold them; each place sends what stands within a period of it, once, to its
   anchor's group;
3. in a group, texts are compared outward from the anchor: a window of ``LENGTH``
   characters that holds it is shared if another record has the same characters
   on both sides. Each place gives one stretch; their union is the result.

So what is moved follows the anchors (fourteen of 183 characters) and the shared
places (one per period), never the characters. The shared hashes and the places
are broadcast where they are counted to be few, and joined by shuffle otherwise;
the texts are read a fixed number of times.

A passage that a third of all records hold would make a group too large for one
task: anchors with more than ``HOT_ROWS`` places are extended by the hashes of
their windows instead, which spread. There, a window that two records of one
block hold is settled in the block, others meet by hash, in salted groups first
where more than ``HOT_BLOCKS`` blocks tell of one. No group lists its pairs.

Defined results: null, empty and short texts share nothing; rows repeated under
one id are one record; equal texts under two ids are shared whole; offsets are
Unicode code points, end exclusive; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .ribbon import mix

LENGTH = 300
#: A perfect difference set: every remainder modulo 183 is a difference of two.
PERIOD = 183
COVER = (0, 1, 3, 16, 23, 28, 42, 76, 82, 86, 119, 137, 154, 175)
#: Rows (hashes, or places) that are broadcast at most: about 16 MB.
BROADCAST_ROWS = 500_000
#: Places of an anchor that one task compares, and places compared at once.
HOT_ROWS, GROUP_ROWS = 10_000, 8_192
#: Characters hashed at once, and per block within which rows are aggregated.
CHUNK_CHARS = 2_000_000
#: Blocks that may tell of one window before such windows meet in salted groups first.
HOT_BLOCKS = 100_000
_U = np.uint64


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _U(0x9FB21C651E98DF25) + b
    x ^= x >> _U(31)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(28)
    return x


def window_hashes(codes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64-bit hashes of all windows of ``length`` code points, by doubling."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, _U)
    power, size, done, acc = mix(codes.astype(_U), seed), 1, 0, None
    while True:
        if length & size:
            part = power[done : done + n]
            acc = part.copy() if acc is None else _join(acc, part)
            done += size
        if size * 2 > length:
            return acc
        power, size = _join(power[:-size], power[size:]), size * 2


def _texts(batches: Iterable[pa.RecordBatch], least: int, chunk_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts of at least ``least`` code points: ids, code points of all
    texts, offsets (len + 1), and where in its text each begins. A text longer than
    a block comes in stretches that overlap by less than one window, so every window
    lies in one of them."""
    ids, parts, sizes, begins, chars = [], [], [], [], 0
    size = max(chunk_chars, 2 * least)

    def block():
        codes = np.frombuffer(b"".join(parts), "<u4")
        return np.array(ids, np.int64), codes, np.r_[0, np.cumsum(sizes)].astype(np.int64), np.array(begins, np.int64)

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i is None or t is None or len(t) < least:
                continue
            for a in range(0, max(1, len(t) - least + 1), size - least + 1):
                x = t if len(t) <= size else t[a : a + size]
                ids.append(i)
                parts.append(x.encode("utf-32-le", "surrogatepass"))
                sizes.append(len(x))
                begins.append(a)
                chars += len(x)
                if chars >= chunk_chars:
                    yield block()
                    ids, parts, sizes, begins, chars = [], [], [], [], 0
                if len(t) <= size:
                    break
    if ids:
        yield block()


def _cover_positions(offsets: np.ndarray, period: int, cover: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and absolute position of every cover position that a window fits."""
    sizes = np.diff(offsets)
    rounds = np.maximum(0, -(-(sizes - window + 1) // period))
    text = np.repeat(np.arange(len(sizes)), rounds)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(rounds) - rounds, rounds)
    at = (turn * period)[:, None] + cover[None, :]
    fits = at + window <= sizes[text][:, None]
    text = np.broadcast_to(text[:, None], at.shape)[fits]
    return text, offsets[text] + at[fits]


def _anchors(offsets: np.ndarray, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    window = length - PERIOD + 1
    text, at = _cover_positions(offsets, PERIOD, np.array(COVER), window)
    return text, at, window_hashes(codes, window, 1)[at] if len(at) else np.empty(0, _U)


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys, in the given order."""
    if not len(order):
        return order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return np.flatnonzero(new)


_NUMBER = np.full(PERIOD, -1, np.int64)
_NUMBER[list(COVER)] = np.arange(len(COVER))


def _emit_anchors(length: int, chunk_chars: int):
    """Per block and anchor: its least and greatest record, the remainders at which it
    stands (bits), the number of its places. In the order of the texts, which packs well."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes, offsets, _ in _texts(batches, length, chunk_chars):
            text, at, h = _anchors(offsets, codes, length)
            order = np.argsort(h, kind="stable")
            heads = _groups(order, h)
            if not len(heads):
                continue
            doc = ids[text][order]
            bit = np.int64(1) << _NUMBER[(at - offsets[text]) % PERIOD][order]
            count = np.diff(np.r_[heads, len(order)])
            cols = [h[order][heads].view(np.int64), np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads), np.bitwise_or.reduceat(bit, heads), count]
            stand = np.argsort(order[heads])
            yield pa.RecordBatch.from_arrays([pa.array(c[stand]) for c in cols], names=["h", "low", "high", "mask", "n"])

    return run


def _emit_places(length: int, chunk_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes, offsets, begins in _texts(batches, length, chunk_chars):
            text, at, h = _anchors(offsets, codes, length)
            cols = [h.view(np.int64), ids[text], at - offsets[text] + begins[text]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "doc", "at"])

    return run


def _emit_contexts(length: int):
    """What stands within a period of each place, left and right of its anchor."""
    size, slack = length - PERIOD + 1, PERIOD - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, places in zip(*(batch.column(c) for c in ("doc", "t", "places"))):
                doc, t, entries = doc.as_py(), text.as_py(), places.values
                at, h = (entries.field(c).to_numpy() for c in ("at", "h"))
                inside = at + size <= len(t)
                at, h = at[inside], h[inside]
                # of rows under one id, only those that have the anchor there
                codes = np.frombuffer("".join(t[p : p + size] for p in at.tolist()).encode("utf-32-le", "surrogatepass"), "<u4")
                real = window_hashes(codes, size, 1)[::size].view(np.int64) == h if len(at) else np.empty(0, bool)
                out += [(x, doc, p, t[max(0, p - slack) : p], t[p + size : p + size + slack]) for x, p in zip(h[real].tolist(), at[real].tolist())]
                if len(out) >= 20_000:
                    yield _context_rows(out)
                    out = []
            if out:
                yield _context_rows(out)

    return run


def _context_rows(rows: list[tuple]) -> pa.RecordBatch:
    h, doc, at, left, right = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(left), pa.array(right)], names=["h", "doc", "at", "left", "right"])


def _matrix(texts: list[str], reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, from the anchor outward, and their numbers."""
    size = np.array([len(x) for x in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(texts)), size)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(texts), PERIOD - 1), np.uint32)
    out[row, size[row] - 1 - column if reverse else column] = flat
    return out, size


def _outward(codes: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, 2, ... code points of each row."""
    values = mix(codes.astype(_U), 4)
    out = np.zeros((len(codes), codes.shape[1] + 1), _U)
    for i in range(codes.shape[1]):
        out[:, i + 1] = _join(out[:, i], values[:, i])
    return out


def _stretches(h: np.ndarray, doc: np.ndarray, left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For places sorted by anchor: the most and the least characters left of the anchor
    that a shared window has (-1, -1 for none). A window with k of them has slack - k on
    the right; it is shared if another record of the group has the same on both sides."""
    slack = PERIOD - 1
    lc, ln = _matrix(left, True)
    rc, rn = _matrix(right, False)
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[head, len(h)])
    most, least = np.full(len(h), -1), np.full(len(h), -1)

    # groups of two: how far both go on alike
    i = head[size == 2]
    i = i[doc[i] != doc[i + 1]]
    if len(i):
        reach = []
        for c, n in ((lc, ln), (rc, rn)):
            alike = np.c_[c[i] == c[i + 1], np.zeros(len(i), bool)]
            reach.append(np.minimum(np.argmin(alike, axis=1), np.minimum(n[i], n[i + 1])))
        l, r = reach
        ok = l + r >= slack
        for j in (i[ok], i[ok] + 1):
            most[j], least[j] = l[ok], slack - r[ok]

    # larger ones: windows of one group with equal hashes on both sides
    big = np.flatnonzero(np.repeat(size > 2, size))
    if len(big):
        group, of = np.repeat(np.arange(len(size)), size)[big].astype(_U), doc[big]
        lh, rh = _outward(lc[big]), _outward(rc[big])
        for k in range(slack + 1):
            fits = np.flatnonzero((ln[big] >= k) & (rn[big] >= slack - k))
            key = _join(lh[fits, k], rh[fits, slack - k])
            order = np.lexsort((key, group[fits]))
            heads = _groups(order, key, group[fits])
            if not len(heads):
                continue
            d = of[fits][order]
            both = np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)
            hit = big[fits[order[np.repeat(both, np.diff(np.r_[heads, len(order)]))]]]
            most[hit] = k
            least[hit[least[hit] < 0]] = k
    return most, least


def _compare(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None
            held = []
            if t is None or not t.num_rows:
                return
            h = t.column("h").to_numpy()
            whole = len(h) if last else int(np.searchsorted(np.cumsum(h[::-1] != h[-1]) > 0, True))
            whole = whole if last else len(h) - whole  # the last group may go on
            if whole < len(h):
                held = [t.slice(whole)]
            if not whole:
                return
            t, h = t.slice(0, whole), h[:whole]
            doc, at = t.column("doc").to_numpy(), t.column("at").to_numpy()
            most, least = _stretches(h, doc, t.column("left").to_pylist(), t.column("right").to_pylist())
            hit = most >= 0
            cols = [doc[hit], (at - most)[hit], (at - least)[hit] + length]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= GROUP_ROWS:
                yield from block(False)
        yield from block(True)

    return run


def _placed(batches: Iterable[pa.RecordBatch], least: int, chunk_chars: int) -> Iterator[tuple]:
    """Blocks as of ``_texts``, with the places of anchors in each stretch."""
    for batch in batches:
        at = [p.values.field("at").to_numpy() for p in batch.column("places")]
        number = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("t")], names=["id", "t"])
        for rows, codes, offsets, begins in _texts([number], least, chunk_chars):
            size = np.diff(offsets)
            mine = [at[r] - b for r, b in zip(rows.tolist(), begins.tolist())]
            mine = [p[(p >= 0) & (p < n + PERIOD)] for p, n in zip(mine, size.tolist())]
            text = np.repeat(np.arange(len(rows)), [len(p) for p in mine])
            yield batch.column("doc").to_numpy()[rows], codes, offsets, begins, text, np.concatenate(mine) + offsets[text]


def _emit_windows(length: int, chunk_chars: int):
    """Per block: spans settled inside it (sure; h2 is their end), and the windows
    that must meet those of other blocks. One row form serves both, so that one pass
    over the texts and one shuffle do."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes, offsets, begins, text, at in _placed(batches, length, chunk_chars):
            if not len(at):
                continue
            # windows that hold an anchor begin in [anchor - slack, anchor]
            slack = PERIOD - 1
            low = np.maximum(at - slack, offsets[text])
            high = np.minimum(at, offsets[text + 1] - length)
            ok = high >= low
            delta = np.zeros(len(codes) + 1, np.int32)
            np.add.at(delta, low[ok], 1)
            np.add.at(delta, high[ok] + 1, -1)
            pos = np.flatnonzero(np.cumsum(delta) > 0)
            if not len(pos):
                continue
            of = np.searchsorted(offsets, pos, side="right") - 1
            h1, h2 = window_hashes(codes, length, 2)[pos], window_hashes(codes, length, 3)[pos]
            doc = ids[of]
            order = np.lexsort((h2, h1))
            heads = _groups(order, h1, h2)
            lens = np.diff(np.r_[heads, len(order)])
            first, last = np.minimum.reduceat(doc[order], heads), np.maximum.reduceat(doc[order], heads)
            settled = np.empty(len(pos), bool)
            settled[order] = np.repeat(first != last, lens)
            at_doc = pos - offsets[of] + begins[of]
            # spans of settled windows: runs of touching windows of one text
            s = np.flatnonzero(settled)
            if len(s):
                begin = np.flatnonzero(np.r_[True, (of[s][1:] != of[s][:-1]) | (pos[s][1:] > pos[s][:-1] + length)])
                end = np.r_[begin[1:], len(s)] - 1
                # their key only spreads them: it meets none but itself
                key = mix(doc[s[begin]].view(np.uint64) + mix(at_doc[s[begin]].view(np.uint64), 5), 9).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, at_doc[s[end]] + length, doc[s[begin]], at_doc[s[begin]])] + [pa.array(np.ones(len(begin), bool))], names=["h1", "h2", "doc", "a", "sure"])
            both = first != last
            o = np.flatnonzero(~settled)
            r1, r2 = h1[order[heads[both]]], h2[order[heads[both]]]
            # a settled window is told to other blocks by its first and last record
            cols = [
                np.concatenate([h1[o], r1, r1]).view(np.int64),
                np.concatenate([h2[o], r2, r2]).view(np.int64),
                np.concatenate([doc[o], first[both], last[both]]),
                np.concatenate([at_doc[o], np.full(2 * both.sum(), -1)]),
            ]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.zeros(len(cols[0]), bool))], names=["h1", "h2", "doc", "a", "sure"])

    return run


def _with_texts(rows: DataFrame, places: DataFrame, count: int, broadcast_rows: int) -> DataFrame:
    """(doc, t, places) of the texts that hold one of ``places`` (h, doc, at)."""
    per = places.groupBy("doc").agg(F.collect_list(F.struct("at", "h")).alias("places"))
    per = F.broadcast(per) if count <= broadcast_rows else per
    return rows.withColumnRenamed("id", "doc").join(per, "doc").select("doc", "t", "places")


def shared_spans(df: DataFrame, key: str, text: str, length: int = LENGTH, broadcast_rows: int = BROADCAST_ROWS, chunk_chars: int = CHUNK_CHARS, hot_rows: int = HOT_ROWS, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """(key, span_start, span_end): the maximal stretches of each record's text
    that lie in runs of ``length`` or more characters of another record."""
    if length < PERIOD + 16:
        raise ValueError(f"length must be at least {PERIOD + 16}")
    rows = df.where(F.char_length(text) >= length).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    anchors = rows.mapInArrow(_emit_anchors(length, chunk_chars), "h bigint, low bigint, high bigint, mask bigint, n bigint")
    merged = anchors.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("mask").alias("mask"), F.sum("n").alias("n"), F.count("*").alias("blocks"))
    # an anchor at one remainder only tells no more than the first remainder's
    merged = merged.where((F.col("low") != F.col("high")) & ((F.bit_count("mask") > 1) | (F.col("mask") == 1)))
    shared = cut(merged.select("h", (F.col("n") > hot_rows).alias("hot"), "blocks"))
    count, most = shared.agg(F.count("*"), F.coalesce(F.max(F.when(F.col("hot"), F.col("blocks"))), F.lit(0))).first()
    told = shared.select("h", "hot")
    all_places = rows.mapInArrow(_emit_places(length, chunk_chars), "h bigint, doc bigint, at bigint")
    places = cut(all_places.join(F.broadcast(told) if count <= broadcast_rows else told, "h"))
    count = places.count()
    texts = _with_texts(rows, places.where("not hot"), count, broadcast_rows)
    contexts = texts.mapInArrow(_emit_contexts(length), "h bigint, doc bigint, at bigint, left string, right string")
    spans = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(length), "doc bigint, a bigint, b bigint")
    if most:
        hot = _with_texts(rows, places.where("hot"), count, broadcast_rows)
        found = hot.mapInArrow(_emit_windows(length, chunk_chars), "h1 bigint, h2 bigint, doc bigint, a bigint, sure boolean")
        salts = -(-most // hot_blocks)
        spans = spans.unionByName(_meet(_salted(found, salts, length) if salts > 1 else found, length))
    return merge_spans(spans, "doc", "a", "b").select(F.col("doc").alias(key), F.col("a").alias("span_start"), F.col("b").alias("span_end"))


def _meet(found: DataFrame, length: int) -> DataFrame:
    """Spans of the windows that two records hold."""
    w = W.partitionBy("h1", "h2")
    met = found.withColumns({"low": F.min("doc").over(w), "high": F.max("doc").over(w)}).where("sure or (low <> high and a >= 0)")
    return met.select("doc", "a", F.when(F.col("sure"), F.col("h2")).otherwise(F.col("a") + length).alias("b"))


def _salted(found: DataFrame, salts: int, length: int) -> DataFrame:
    """The same rows after a first meeting within salted groups: what is shared there
    is sure, and a group tells the others no more than its two outer records."""
    w = W.partitionBy("h1", "h2", "salt")
    first = F.row_number().over(w.orderBy("doc")) == 1
    met = found.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts))).withColumns({"low": F.min("doc").over(w), "high": F.max("doc").over(w), "first": first})
    here = F.col("low") != F.col("high")
    told = F.when(F.col("first") & ~F.col("sure"), F.when(here, F.array("low", "high")).when(F.col("a") < 0, F.array("low")))
    row = lambda h2, doc, a, sure: F.struct(F.col("h1"), h2.alias("h2"), doc.alias("doc"), a.alias("a"), sure.alias("sure"))
    own = (
        F.when(F.col("sure"), row(F.col("h2"), F.col("doc"), F.col("a"), F.lit(True)))
        .when((F.col("a") >= 0) & here, row(F.col("a") + length, F.col("doc"), F.col("a"), F.lit(True)))
        .when(F.col("a") >= 0, row(F.col("h2"), F.col("doc"), F.col("a"), F.lit(False)))
    )
    others = F.transform(F.coalesce(told, F.array().cast("array<bigint>")), lambda d: row(F.col("h2"), d, F.lit(-1).cast("bigint"), F.lit(False)))
    rows = F.filter(F.concat(F.array(own), others), lambda x: x.isNotNull())
    return met.select(F.explode(rows).alias("x")).select("x.*")


def merge_spans(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping and touching spans of a record become one."""
    w = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def shared_share(spans: DataFrame, df: DataFrame, key: str, text: str, every: bool = False) -> DataFrame:
    """(key, n_chars, shared_chars, share) of every record with a shared span, or of
    ``every`` record with a key: then shared_chars is 0 where nothing is shared, and
    share is null where there is no text or an empty one."""
    sums = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.char_length(text)).cast("bigint").alias("n_chars"))
    out = sizes.join(sums, key, "left" if every else "inner").fillna(0, ["shared_chars"])
    return out.select(key, "n_chars", "shared_chars", F.try_divide("shared_chars", "n_chars").alias("share"))
