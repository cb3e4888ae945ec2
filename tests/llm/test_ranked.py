import math
import random
import re
from collections import Counter

import pytest

from shroudline.llm import ranked

from .conftest import CLASH, ODD


def split(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)


def brute(docs, items, k=10):
    """docs and items: (id, text). Rows (item_id, rank, doc_id, score)."""
    words = [split(t) for _, t in docs]
    n_docs, n_terms = sum(bool(w) for w in words), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    counts, out = [Counter(w) for w in words], []
    for item_id, text in items:
        rows = []
        for (doc_id, _), w, c in zip(docs, words, counts):
            m = 100 - 75 + 75 * len(w) * n_docs // n_terms if w else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, doc_id, -s) for rank, (s, _, _, doc_id) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", *[f"W{k}" for k in range(60)], "größe", "漢字", "x1", "İ"]
    weights = [400, 300, *[60 / (k + 1) for k in range(60)], 3, 3, 1, 1]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 80))) + rng.choice(["", "!", "-w3-W3", " THE_end"]) for _ in range(n)]


def result(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


@pytest.fixture
def make_items(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string")


def test_ranking_equals_brute_force(make_docs, make_items):
    docs = list(enumerate([*ODD, *texts(150, 1)], 1))
    items = list(enumerate([*texts(12, 2), "w3 w3 w3 the", "unheard-of", "", None, "THE the", "漢字 Größe"]))
    assert result(ranked.search(make_docs(docs, CLASH), make_items(items))) == brute(docs, items)


def test_small_windows_and_blocks_change_nothing(make_docs, make_items, monkeypatch):
    docs, items = list(enumerate(texts(90, 3))), list(enumerate(texts(7, 4)))
    monkeypatch.setattr(ranked, "WINDOW", 8)
    frame = make_docs(docs).coalesce(1)
    assert result(ranked.search(frame, make_items(items), k=4, block_items=3, block_terms=40)) == brute(docs, items, 4)


def test_windows_keep_ties_in_the_order_of_ids(make_docs, make_items, monkeypatch):
    docs = [(k, "same words here") for k in (9, 3, 7, 1, 5, 2, 8, 6, 4)] + [(10, "other"), (11, "more"), (12, "else"), (13, "any")]
    segment = ranked.Segment([[(0, 1)]], ranked.np.array([5]), 13, 31, 4)
    for ids in ([1, 2, 3], [4, 5, 6]):
        segment.add(ids, [3] * 3, ranked.np.arange(4), ranked.np.zeros(3, dtype=int), ranked.np.ones(3, dtype=int))
    assert [x[2] for x in sorted(segment.heaps[0], reverse=True)] == [1, 2, 3, 4]
    got = result(ranked.search(make_docs(docs), make_items([(1, "words")]), k=4))
    assert [r[2] for r in got] == [1, 2, 3, 4]


def test_rows_without_an_id_or_sharing_one(make_docs, make_items):
    docs = [(None, "a b"), (5, "a b"), (5, "a b"), (5, "c c c"), (6, "d e f"), (7, "g h i"), (8, "k l m")]
    items = [(None, "a"), (1, "c"), (1, "a b")]
    assert result(ranked.search(make_docs(docs), make_items(items))) == brute(docs, items)


def test_empty_tables(make_docs, make_items):
    assert result(ranked.search(make_docs([]), make_items([(1, "a")]))) == []
    assert result(ranked.search(make_docs(["a"]), make_items([]))) == []
    assert result(ranked.search(make_docs([None, ""]), make_items([(1, "a")]))) == []


def test_lengths_beyond_64_bits_of_products():
    segment = ranked.Segment([[(0, 1)]], ranked.np.array([5]), 10**10, 10**13, 1)
    segment.add([1], [10**9], ranked.np.array([0, 1]), ranked.np.array([0]), ranked.np.array([3]))
    assert segment.heaps[0][0][0] == 5 * (3 * 10**9 // (3000 + 8 * (25 + 75 * 10**9 * 10**10 // 10**13)))
