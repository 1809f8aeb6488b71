"""The leak search against an exhaustive alignment, and its sketches' promise that nothing is missed."""

import random
import time

import numpy as np
import pytest
from conftest import rows

from tallyrill.llm.leakage import LeakIndex, find_leaks, plain_words, untouched_run, window_minima

WORDS = [f"w{i}" for i in range(400)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = "changed"
        elif kind < 0.7:
            del words[at]
        else:
            words.insert(at, "inserted")
    return words


def exhaustive(item, text, passage=20, rate=10, share=0.0):
    """Longest-reach table over all starts; plain Python."""
    n, m, most = len(item), len(text), len(item) // rate
    passage = max(passage, -int(-share * len(item) // 1))
    reach = {}
    for i in range(1, n + 1):
        for j in range(m + 1):
            for e in range(most + 1):
                best = -1
                if j and item[i - 1] == text[j - 1]:
                    best = max(best, (reach.get((i - 1, j - 1, e), 0 if e == 0 else -1)) + 1 if e == 0 or reach.get((i - 1, j - 1, e), -1) >= 0 else -1)
                if e:
                    for a, b, gain in ((i - 1, j - 1, 1), (i - 1, j, 1), (i, j - 1, 0)):
                        if b >= 0 and (v := reach.get((a, b, e - 1), -1)) > 0:
                            best = max(best, v + gain)
                if best > 0:
                    reach[i, j, e] = best
                    if best >= max(passage, rate * e):
                        return True
    return False


@pytest.mark.parametrize(("seed", "share"), [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0), (4, 0.6), (5, 0.8)])
def test_search_against_alignment(seed, share):
    rng = random.Random(seed)
    items = [[rng.choice(WORDS) for _ in range(rng.randrange(15, 60))] for _ in range(12)]
    index = LeakIndex.build([(i, " ".join(w)) for i, w in enumerate(items)], 5, 20, 10, share)
    texts = []
    for _ in range(60):
        item = rng.choice(items)
        size = rng.randrange(12, 60 if share else 40)
        start = rng.randrange(max(1, len(item) - size + 1))
        part = edited(rng, item[start : start + size], rng.randrange(0, 5))
        texts.append([rng.choice(WORDS) for _ in range(rng.randrange(20))] + part + [rng.choice(WORDS) for _ in range(rng.randrange(20))])
    got = {(t, index.items[i].key) for t, i in index.search([" ".join(t) for t in texts])}
    want = {(t, i) for t, text in enumerate(texts) for i, item in enumerate(items) if len(item) >= 20 and exhaustive(item, text, share=share)}
    assert got == want and want


def test_repeated_words_against_alignment():
    rng = random.Random(9)
    items = [[rng.choice("ab") for _ in range(30)] for _ in range(6)]
    index = LeakIndex.build([(i, " ".join(w)) for i, w in enumerate(items)], 5, 20, 10)
    texts = [[rng.choice("ab") for _ in range(60)] for _ in range(30)]
    got = {(t, index.items[i].key) for t, i in index.search([" ".join(t) for t in texts])}
    assert got == {(t, i) for t, text in enumerate(texts) for i, item in enumerate(items) if exhaustive(item, text)} and got


def test_partitions_differ_in_width():
    rng = random.Random(2)
    rows = [(n, " ".join(rng.choice(WORDS) for _ in range(n))) for n in (20, 30, 200, 1000, 5000)]
    assert [p.width for p in LeakIndex.build(rows, 5, 20, 10, 0.5).partitions] == [2, 5]
    assert [p.width for p in LeakIndex.build(rows, 5, 20, 10).partitions] == [2]


def test_long_near_miss_is_quick():
    rng = random.Random(5)
    item = [f"x{i}" for i in range(5000)]
    text = [w for i in range(0, 5000, 12) for w in [*item[i : i + 12], *(rng.choice(WORDS) for _ in range(6))]]
    index = LeakIndex.build([(1, " ".join(item))], 5, 20, 10)
    began = time.perf_counter()
    assert index.search([" ".join(text), " ".join(["a b c d e f"] * 20_000)]) == []
    assert time.perf_counter() - began < 2  # the alignment of all words took minutes


def test_sketches_promise():
    assert untouched_run(20, 20, 10) == 6
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 7):
        text = rng.integers(0, 2**63, 200).astype(np.uint64)
        minima = set(text[window_minima(text, width)].tolist())
        for start in range(0, 190, 3):
            part = text[start : start + width]
            assert set(part[window_minima(part, width)].tolist()) <= minima


def test_plain_words():
    base = plain_words("The quick brown fox's tail isn't naive, see page 5.")
    for other in ("THE  quick\r\nbrown fox’s tail isn't naïve — see page 5", "<p>The <b>quick</b> br<i>ow</i>n fox&#39;s tail isn&rsquo;t naive,<br/>see page&nbsp;5.</p>", "The qu​ick bro­wn fox's tail isn't na\\u0069ve,\\nsee page 5", "> The *quick* **brown** fox's ta-\n> il isn't `naive`, [see](http://x.y/z) page 5"):
        assert plain_words(other) == base


def test_rows(spark):
    passage = " ".join(WORDS[:30])
    texts = spark.createDataFrame([(1, "noise " * 50 + passage), (1, "noise " * 50 + passage), (2, None), (3, ""), (4, "x " * 200_000 + passage.upper()), (5, " ".join(WORDS[:15]))], "doc_id bigint, text string").selectExpr("*", "0 as _item")
    items = spark.createDataFrame([(7, passage), (7, passage), (8, None), (9, "too short"), (10, " ".join(WORDS[300:340]))], "item_id bigint, text string")
    assert rows(find_leaks(texts, items, "doc_id", "text", "item_id", "text")) == [(1, 7), (4, 7)]
    assert rows(find_leaks(texts, items, "doc_id", "text", "item_id", "text", index_chars=60)) == [(1, 7), (4, 7)]  # in blocks
    assert find_leaks(texts.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert find_leaks(texts, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0
