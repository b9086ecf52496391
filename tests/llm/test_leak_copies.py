"""A leak is found however often a document repeats its passage."""

from __future__ import annotations

import random

import pytest

from lexiloom.llm import leaks


@pytest.mark.parametrize("copies", [1, 64, 65, 200])
def test_repeated_passage(copies):
    words = [f"w{i}x" for i in range(90)]
    passage = words[20:60]
    passage[20] = "changed"
    filler = " ".join(f"f{i}y" for i in range(30))
    text = f" {filler} ".join([" ".join(passage)] * copies)
    assert leaks.leaked([text], leaks.Items([(1, " ".join(words))])) == [(0, 0)]


def brute(docs, items):
    """Leaks from every maximal match, found by comparing all places, and from chains over all predecessors."""
    spelled, out = {v: k for k, v in items.vocabulary.items()}, []
    for d, text in enumerate(docs):
        a = leaks.words(text)
        for i in range(len(items.ids)):
            b = [spelled[x] for x in items.stream[items.item == i].tolist()]
            runs = []
            for k in range(len(a)):
                for p in range(len(b)):
                    if a[k] == b[p] and (k == 0 or p == 0 or a[k - 1] != b[p - 1]):
                        n = 0
                        while k + n < len(a) and p + n < len(b) and a[k + n] == b[p + n]:
                            n += 1
                        if n >= min(leaks.SEED, len(b)):
                            runs.append((p, p + n, k - p))
            ends, best = [], (0, 0)
            for start, end, diagonal in sorted(runs):
                new = (start, end - start)
                for s, e, g, m in reversed(ends):
                    if abs(g - diagonal) <= leaks.DRIFT and start - e <= leaks.GAP and end > e and m + min(end - start, end - e) > new[1]:
                        new = (s, m + min(end - start, end - e))
                ends.append((new[0], end, diagonal, new[1]))
                best = max(best, (new[1], end - new[0]))
            if runs and best[1] >= leaks.PASSAGE * len(b) and best[0] >= leaks.MATCHED * len(b):
                out.append((d, i))
    return out


@pytest.mark.parametrize("most", [10**9, 300, 40])
def test_leaks_of_repetitive_texts_equal_brute_force(most):
    rng = random.Random(7)
    for _ in range(8):
        vocabulary = [f"w{i}" for i in range(rng.choice([2, 4, 30]))]
        texts = [rng.choices(vocabulary, k=rng.choice([1, 3, 5, 20, 40])) for _ in range(4)]
        items = leaks.Items([(i, " ".join(t)) for i, t in enumerate(texts)])
        docs = [" ".join(rng.choices(vocabulary, k=rng.randrange(80)) + rng.choice(texts)[3:25] + rng.choices(vocabulary, k=20)) for _ in range(4)]
        assert leaks.leaked(docs, items, most) == brute(docs, items)


def test_stray_matches_between_two_halves():
    words = [f"w{i}x" for i in range(160)]
    stray = " ".join(" ".join(words[40:46]) + f" s{i}" for i in range(70))
    text = " ".join(words[:60]) + " changed " + " ".join(words[61:]) + " " + stray
    assert leaks.leaked([stray + " " + text], leaks.Items([(1, " ".join(words))])) == [(0, 0)]


def test_short_items_must_stand_whole():
    items = leaks.Items([(1, "Hổ Lang chạy"), (2, "闭关")])
    assert leaks.leaked(["Ngựa của HỔ LANG, chạy nhanh", "Hổ Lang đi", "他闭关了"], items) == [(0, 0), (2, 1)]


def test_hot_phrase_is_searched_in_parts():
    items = leaks.Items([(i, "ha " * 60) for i in range(5)])
    assert leaks.leaked(["ha " * 3000, "ho"], items, 5000) == [(0, i) for i in range(5)]


def test_items_in_sets(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}y{j}" for j in range(20))) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(100 + i, f"ok {r.text} ok") for i, r in enumerate(items.collect())], "doc_id long, text string")
    assert sorted(map(tuple, leaks.leaks(docs, items, most_chars=300).collect())) == [(100 + i, i) for i in range(9)]
