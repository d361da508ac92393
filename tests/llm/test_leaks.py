import random

import numpy as np
import pytest
from conftest import rows
from oracle import DATA

from stowage.llm import leaks, queries
from stowage.llm.fmindex import FMIndex, suffix_order


def test_suffix_order_and_search():
    r = np.random.default_rng(2)
    for n, sigma in ((1, 2), (2, 3), (60, 3), (500, 5), (3000, 40)):
        s = np.r_[r.integers(1, sigma, n - 1), 0].astype(np.int64)
        want = sorted(range(n), key=lambda i: s[i:].tolist())
        assert suffix_order(s).tolist() == want
        index = FMIndex(s, sigma)
        text = s.tolist()
        for k in (1, 2, 4):
            patterns = r.integers(1, sigma, (30, k))
            low, high = index.search(patterns)
            for p, a, b in zip(patterns.tolist(), low, high):
                places = sorted(index.locate(np.arange(a, b)).tolist())
                assert places == [i for i in range(n - k + 1) if text[i : i + k] == p]


def edits(item, text):
    """Whether a window of 12 or more item words matches, over all pairs of windows."""
    m = len(item)
    for a in range(m):
        for c in range(len(text)):
            if item[a] != text[c]:
                continue
            cost = {0: 0}
            prev = {j: j - c - 1 if j > c else 9**9 for j in range(len(text) + 1)}
            prev[c + 1] = 0
            for i in range(a + 1, m):
                now = {c: 9**9}
                for j in range(c + 1, len(text) + 1):
                    sub = prev[j - 1] + (item[i] != text[j - 1]) if j - 1 > c else 9**9
                    now[j] = min(sub, prev[j] + 1, now[j - 1] + 1)
                    n = i + 1 - a
                    if j - 1 > c and item[i] == text[j - 1] and n >= leaks.RUN and prev[j - 1] * leaks.ALLOWANCE <= n:
                        return True
                prev = now
            del cost
    return False


def test_alignment_against_brute_force():
    r = random.Random(4)
    seen = set()
    for _ in range(150):
        item = [r.randint(0, 60) for _ in range(r.randint(12, 22))]
        a = r.randint(0, len(item) - 8)
        piece = item[a:]
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(piece))
            piece[k : k + 1] = r.choice([[], [99], [piece[k], 98]])
            if not piece:
                piece = [97]
        text = [r.randint(0, 60) for _ in range(5)] + piece + [r.randint(0, 60) for _ in range(5)]
        want = edits(item, text)
        seen.add(want)
        for whole in (True, False):
            assert bool(leaks.run_ranges(item, text, whole)) == want
    assert seen == {True, False}


def every_run(item, text):
    """The words of the text in some run, one start and one edit table at a time."""
    out = set()
    for a in range(len(item) - leaks.RUN + 1):
        for c in range(len(text)):
            if item[a] != text[c]:
                continue
            row = list(range(len(text) - c))  # row[j]: least edits of item[a:i] against text[c : c + j + 1]
            for i in range(a + 1, len(item)):
                now = [row[0] + 1]
                for j in range(1, len(row)):
                    same = item[i] == text[c + j]
                    if same and i + 1 - a >= leaks.RUN and row[j - 1] * leaks.ALLOWANCE <= i + 1 - a:
                        out |= set(range(c, c + j + 1))
                    now.append(min(row[j - 1] + (not same), row[j] + 1, now[-1] + 1))
                row = now
    return out


@pytest.mark.parametrize("cells", [50, 4_000_000])
def test_ranges_are_those_of_all_runs(monkeypatch, cells):
    monkeypatch.setattr(leaks, "BATCH_CELLS", cells)
    r = random.Random(7)
    seen = set()
    for _ in range(80):
        item = [r.randint(2, r.choice([9, 60])) for _ in range(r.randint(12, 26))]
        text = [r.randint(2, 60) for _ in range(4)]
        for _ in range(2):
            piece = item[r.randint(0, 3) :]
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(piece))
                piece[k : k + 1] = r.choice([[], [99], [piece[k], 98]])
            text += piece + [r.randint(2, 60) for _ in range(r.randint(0, 6))]
        got = leaks.run_ranges(np.array(item), np.array(text))
        words = {x for a, b in got for x in range(a, b)}
        assert words == every_run(item, text) and sum(b - a for a, b in got) == len(words)
        seen.add(bool(got))
    assert seen == {True, False}


ITEM = "Every quiet morning the old baker carried seven warm loaves across that narrow bridge before anyone else was awake"


def find(spark, texts, items=((1, ITEM),)):
    d = spark.createDataFrame(list(texts), "doc_id long, text string").selectExpr("*", "1 as id", "2 as item_id")
    i = spark.createDataFrame(list(items), "item_id long, text string").selectExpr("*", "'x' as doc_id")
    return d, i, rows(leaks.leaks(d, "doc_id", "text", i, "item_id", "text"))


def test_disguises_and_short_runs(spark):
    w = ITEM.split()
    texts = [
        (1, "Before. " + ITEM.upper() + " After."),
        (2, " ".join(w[3:15])),
        (3, " ".join(w[3:14])),  # eleven words
        (4, "<p>" + "</b> <i>".join(w) + "</p>"),
        (5, "; ".join(w[:5] + ["XX"] + w[6:12]) + "!"),  # one changed
        (6, " ".join(w[:4] + ["and"] + w[4:9] + w[10:13])),  # one added, one missing
        (7, " ".join(w[:4] + ["a"] + w[5:8] + ["b"] + w[9:10] + ["c"] + w[11:13])),  # three of thirteen
        (8, ITEM.replace("e", "e​").replace(" ", "\n\t  ")),
        (12, "[12] ".join(w[2:16]).replace("bridge", "[bridge](http://x.y/z)")),
        (13, "".join(f'{x} <a href="http://x.y/{"long-path/" * 60}" class="big red">' for x in w[1:15])),
        (14, "".join(f'[{x}](http://x.y/a_({k})/{"z" * 400} "a title") ' for k, x in enumerate(w[1:15]))),
        (9, None),
        (10, ""),
        (11, "word " * 20000 + ITEM),
        (1, "Before. " + ITEM.upper() + " After."),
    ]
    _, _, got = find(spark, texts)
    assert got == [(1, 1), (11, 1), (12, 1), (13, 1), (14, 1), (2, 1), (4, 1), (5, 1), (6, 1), (8, 1)]


def test_composition(spark):
    item = "été très né à côté où père mère frère élève forêt île août fête"
    import unicodedata

    _, _, got = find(spark, [(1, unicodedata.normalize("NFD", item)), (2, "x")], [(7, item)])
    assert got == [(1, 7)]


def test_composition_of_kana(spark):
    import unicodedata

    item = "がぎぐげござじずぜぞだぢばびぶべぱぴガギグパピプ"
    half = "".join(chr(0xFF76 + n) + "\uff9e" for n in range(12))  # half-width, each with its mark
    full = unicodedata.normalize("NFKC", half)
    _, _, got = find(spark, [(1, unicodedata.normalize("NFD", item)), (2, half), (3, "かきくけこさしすせそたちはひふへはひカキクハヒフ")], [(7, item), (8, full)])
    assert got == [(1, 7), (2, 8)]


def test_removal_spans_and_empty_sides(spark):
    d, i, _ = find(spark, [(1, "Hello. " + ITEM + " Bye. " + ITEM)])
    spans = rows(leaks.removal_spans(d, "doc_id", "text", i, "item_id", "text"))
    assert [("Hello. " + ITEM + " Bye. " + ITEM)[a:b] for _, a, b in spans] == [ITEM, ITEM]
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d, i.selectExpr("item_id", "cast(null as string) as text"))):
        assert leaks.leaks(a, "doc_id", "text", b, "item_id", "text").count() == 0
    short = spark.createDataFrame([(1, "only a few words here")], "item_id long, text string")
    assert leaks.leaks(d, "doc_id", "text", short, "item_id", "text").count() == 0


def test_removal_spans_reach_over_whole_runs(spark):
    w = ITEM.split()
    run = " ".join(w[:3] + ["XX"] + w[4:8] + ["YY"] + w[9:12])  # one phrase of four words stays
    stray = " ".join(w[4:8])
    texts = ["Go. " + run + " Bye.", ITEM + " one two three " + stray + " end", "Then " + " ".join(w[:14] + ["ZZ"] + w[15:18]) + " then"]
    d, i, _ = find(spark, enumerate(texts))
    got = [texts[n][a:b] for n, a, b in rows(leaks.removal_spans(d, "doc_id", "text", i, "item_id", "text"))]
    assert got == [run, ITEM, texts[2][5:-5]]


def test_blocks_of_items_and_texts_change_nothing(spark, monkeypatch):
    want = rows(queries.p7_found(spark, DATA))
    monkeypatch.setattr(leaks, "ITEM_BLOCK_CHARS", 10_000)
    d, i = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "eval_items"))
    assert rows(leaks.leaks(d, "doc_id", "text", i, "item_id", "text", chunk_chars=5_000)) == want
    assert rows(leaks.leaks(d, "doc_id", "text", i, "item_id", "text", index_words=150)) == want
    monkeypatch.setattr(leaks, "PASS_CHARS", 25_000)
    assert rows(leaks.leaks(d, "doc_id", "text", i, "item_id", "text")) == want
    monkeypatch.setattr(leaks, "ITEM_BLOCK_CHARS", 10**7)
    monkeypatch.setattr(leaks, "PASS_CHARS", 10**8)
    spans = rows(leaks.removal_spans(d, "doc_id", "text", i, "item_id", "text"))
    assert rows(leaks.removal_spans(d, "doc_id", "text", i, "item_id", "text", index_words=150)) == spans


def shard(texts, items, index_words=leaks.INDEX_WORDS, whole=True):
    longest = int(items.sizes.max(initial=0))
    return list(leaks._shard(texts, items.vocabulary, lambda: [items], longest, leaks.Words(), {}, index_words, whole))


def test_long_texts_in_stretches(monkeypatch):
    monkeypatch.setattr(leaks, "LONG_CHARS", 100)
    items = leaks.Items([(1, ITEM)])
    text = "x " * 500 + ITEM + " y" * 300 + " " + ITEM
    found = {(a, b) for _, _, a, b in shard([text], items, 40)}
    n = len(ITEM.split())
    assert {(500, 500 + n), (800 + n, 800 + 2 * n)} <= found


def test_a_short_run_within_every_long_one():
    """Long items with edits everywhere: the search near the phrases finds what the whole
    alignment finds."""
    r = random.Random(12)
    seen = set()
    for _ in range(60):
        item = np.array([r.randint(2, 400) for _ in range(r.randint(40, 160))])
        piece, k, longest = [], 0, r.choice([7, 8, 10])
        while k < len(item):  # four to nine equal words, then three edits
            n, e = r.randint(4, longest), 3
            piece += item[k : k + n].tolist()
            for w in item[k + n : k + n + e].tolist():
                piece += r.choice([[], [999], [w, 998]])
            k += n + e
        whole, near = (bool(leaks.run_ranges(item, piece, x)) for x in (True, False))
        assert whole == near
        seen.add(whole)
    assert seen == {True, False}


def test_stray_phrases_are_no_part_of_a_span():
    r = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    item = r.sample(words, 200)
    text = [f"t{i}" for i in range(400)]
    for at in range(0, 400, 30):
        text[at : at + 4] = item[at // 2 : at // 2 + 4]
    text[100:112] = item[40:52]
    text[112] = "other"
    found = shard([" ".join(text)], leaks.Items([(7, " ".join(item))]))
    assert leaks._merged((a, b) for _, _, a, b in found) == [(100, 112)]


def test_many_items_with_one_opening(monkeypatch):
    """Pairs that share the opening only are told apart without a call for each."""
    import time

    r = random.Random(4)
    opening = "what is the best way to answer"
    items = leaks.Items([(i, opening + " " + " ".join(f"i{i}x{k}" for k in range(13))) for i in range(2000)])
    texts = [opening + " " + " ".join(f"t{r.randint(0, 10**6)}" for _ in range(30)) for _ in range(100)] + [opening + " " + " ".join(f"i77x{k}" for k in range(13))]
    began = time.perf_counter()
    assert {(n, i) for n, i, _, _ in shard(texts, items)} == {(100, 77)}
    assert time.perf_counter() - began < 5
    monkeypatch.setattr(leaks, "PAIRS", 500)
    assert {(n, i) for n, i, _, _ in shard(texts[95:], items)} == {(5, 77)}


def test_long_items_are_quick():
    import time

    r = random.Random(5)
    item = [r.randint(2, 3000) for _ in range(800)]
    text = [r.randint(2, 3000) for _ in range(50)] + [w if r.random() > 0.1 else 9999 for w in item]
    for whole, bound in ((True, 2), (False, 0.2)):
        began = time.perf_counter()
        got = leaks.run_ranges(item, text, whole)
        took = time.perf_counter() - began
        print(whole, took)
        assert got and took < bound, (got, took)
    assert len(got := leaks.run_ranges(item, text)) == 1 and got[0][1] - got[0][0] > 780


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_runs_are_found(spark, seed):
    """Every run with allowed edits holds an unchanged phrase, so none is missed."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    items = [[r.choice(words) for _ in range(r.randint(12, 40))] for _ in range(20)]
    texts, want = [], set()
    for n in range(200):
        item = r.choice(items)
        a = r.randint(0, len(item) - 12)
        run = item[a : r.randint(a + 12, len(item))]
        spots = r.sample(range(1, len(run) - 1), len(run) // 6)
        hurt = [x for k, w in enumerate(run) for x in (r.choice([[], ["zz"], [w, "yy"]]) if k in spots else [w])]
        texts.append((n, " ".join(r.choice(words) for _ in range(9)) + " " + " ".join(hurt)))
        want.add((n, items.index(item)))
    _, _, got = find(spark, texts, [(i, " ".join(x)) for i, x in enumerate(items)])
    assert set(got) == want
