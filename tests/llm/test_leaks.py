import random
import time

import numpy as np
import pytest

pytest.importorskip("ledgerfen.llm")
from ledgerfen.llm import leaks
from ledgerfen.llm.leaks import tile, words


def test_words():
    assert words("Größe, ÉTÉ! can't 2nd_x") == ["grosse", "ete", "can", "t", "2nd", "x"]
    assert words("re-\n  solved well-\nknown re­\nsult in­side a -\nb") == ["resolved", "wellknown", "result", "inside", "a", "b"]
    assert words("a (b [c] d) e [f] g ( h") == ["a", "e", "g", "h"]
    assert words("zero​width no\xa0break été ﻿ﬁne") == ["zerowidth", "no", "break", "ete", "fine"]
    assert words(None) == words("") == words(" \n") == words("(only this)") == []


def slow_tiles(d, e, k):
    """The definition, by trying every pair of places after each mark."""
    dm, em, out = [False] * len(d), [False] * len(e), []
    while True:
        best = None
        for i in range(len(d)):
            for j in range(len(e)):
                n = 0
                while i + n < len(d) and j + n < len(e) and d[i + n] == e[j + n] >= 0 and not dm[i + n] and not em[j + n]:
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        for x in range(best[2]):
            dm[best[0] + x] = em[best[1] + x] = True


def test_tiles_against_the_definition():
    rng = random.Random(2)
    for _ in range(400):
        d = [rng.randrange(-1, 3) for _ in range(rng.randrange(0, 25))]
        e = [rng.randrange(0, 3) for _ in range(rng.randrange(0, 18))]
        k = rng.randrange(1, 5)
        assert tile(np.array(d, np.int64), np.array(e, np.int64), k) == slow_tiles(d, e, k)


def test_long_runs_of_the_same_words():
    began = time.time()
    d, e = np.zeros(20_000, np.int64), np.zeros(2_000, np.int64)
    assert tile(d, e, 5) == [(0, 0, 2_000)]
    turns = np.arange(20_000) % 7
    assert tile(turns, turns[3:2_003], 5) == [(3, 0, 2_000)]
    assert time.time() - began < 2


def test_candidates_are_bounded_by_the_coverage():
    rng, index = random.Random(4), None
    for _ in range(60):
        docs = [[rng.choice("abcd") for _ in range(rng.randrange(0, 30))] for _ in range(5)]
        items = [(n, [rng.choice("abcd") for _ in range(rng.randrange(3, 15))]) for n in range(4)]
        index = leaks.ItemIndex(items, 3)
        index.TOGETHER = rng.choice([1, 4_000_000])
        for share in (0.0, 0.5, 0.8):
            kept = {(d, i): ids for d, ids, i in index.candidates(docs, share)}
            for d, doc in enumerate(docs):
                own = np.array([index.vocabulary.get(w, -1) for w in doc], np.int64)
                for i, (_, ids) in enumerate(index.items):
                    covered = sum(t[2] for t in tile(own, ids, 3))
                    if covered and covered >= share * len(ids):
                        assert kept[d, i].tolist() == own.tolist()
    assert list(leaks.ItemIndex([], 3).candidates([["a"]])) == []


def longest_common(d, e):
    best = 0
    for i in range(len(d)):
        for j in range(len(e)):
            n = 0
            while i + n < len(d) and j + n < len(e) and d[i + n] == e[j + n]:
                n += 1
            best = max(best, n)
    return best


ITEM = "The quick brown fox jumps over the lazy dog while nine green birds sing at dawn near Größenfeld station today"


@pytest.fixture
def tables(spark):
    w = ITEM.split()
    docs = [
        (1, "x y z " + " ".join(w[2:17]) + " end"), (2, " ".join(w[2:16])), (3, " ".join(w[:7]).upper() + " (Laughter) " + " ".join(w[7:18]).replace("ö", "ö")),
        (4, " ".join(w[:8]) + " other " + " ".join(w[8:])), (5, None), (6, ""), (7, "\n".join(w)), (8, " ".join(w[10:]) + " . " + " ".join(w[:10])), (None, ITEM), (1, "x y z " + " ".join(w[2:17]) + " end"),
    ]
    items = [(10, "s", ITEM), (11, "s", None), (12, "s", "short"), (13, "s", "unrelated words only " * 8), (10, "s", ITEM)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, suite string, text string")


def test_found(tables):
    docs, items = tables
    found = leaks.find_leaks(docs, items, 15, 15)
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == sorted([(1, 10), (1, 10), (3, 10), (7, 10), (None, 10)], key=str)
    blocks = leaks.find_leaks(docs, items, 15, 15, block_words=25)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, found.collect()))


def test_reordered_passages_are_covered(tables):
    docs, items = tables
    covered = {r.doc_id: (r.tiles, r.covered) for r in leaks.find_leaks(docs, items, 5, min_coverage=0.8).collect()}
    assert covered[8] == (2, 20) and covered[4] == (2, 20) and covered[7] == (1, 20)
    assert set(covered) == {3, 4, 7, 8, None} and covered[3] == (1, 18)


def test_empty_tables(tables):
    docs, items = tables
    assert leaks.find_leaks(docs.limit(0), items, 15).count() == 0
    assert leaks.find_leaks(docs, items.limit(0), 15).count() == 0


def test_random_texts_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(6)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(12)]
    for i in range(0, 60, 3):  # planted parts of items
        at = rng.randrange(0, 15)
        text = docs[i][1].split()
        text[10 : 10 + 12] = items[i % 12][1].split()[at : at + 12]
        docs[i] = (i, " ".join(text))
    k = 6
    expected = {(d, i) for d, x in docs for i, y in items if longest_common(x.split(), y.split()) >= k}
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected


def test_coverage_of_reordered_passages_against_the_definition(spark):
    """Documents with the parts of an item in another order, whole, changed or cut: what covers four fifths is found, and no more."""
    rng = random.Random(12)
    items = [(i, [f"i{i}w{n}" for n in range(40)]) for i in range(10)]
    docs = []
    for n in range(60):
        _, w = rng.choice(items)
        cut = rng.randrange(8, 32)
        parts = [w[cut:], ["x"] * rng.randrange(1, 4), w[:cut]]
        text = [x for part in parts for x in part]
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = "y"
        docs.append((n, text))
    number = {}
    ids = lambda ws: [number.setdefault(w, len(number)) for w in ws]
    expected = {(d, i) for d, t in docs for i, w in items if t and sum(x[2] for x in slow_tiles(ids(t), ids(w), 5)) >= 0.8 * len(w)}
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string") for name, rows in (("doc_id", docs), ("item_id", items))]
    found = leaks.find_leaks(*frames, 5, min_coverage=0.8)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and 5 < len(expected) < 60
