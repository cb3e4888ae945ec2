import os
import random

import numpy as np
import pytest

from shroudline.llm import substrings

from .conftest import CLASH, ODD


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_gear_hash_is_the_recurrence():
    data = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(substrings._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert substrings.gear_hashes(data).tolist() == want


def test_words_are_cut_the_same_way_by_both_functions():
    rng = random.Random(1)
    for text in [*ODD, prose(rng, 300) + " " + "é" * 1000 + "\t\n tail", *[f" {unspaced(rng, 500, k)} {prose(rng, 9)}\n" for k in ("chinese", "thai", "json", "base64")]]:
        raw = (text or "").encode()
        starts, ends = substrings.word_bounds(raw)
        words = substrings.words_of(raw)
        assert [raw[a:b] for a, b in zip(starts, ends)] == words
        assert b"".join(words) == b"".join(raw.split())
        for w in words:
            w.decode()  # never inside a character


def test_any_fifteen_words_hold_a_beginning_that_depends_on_them_only():
    rng = np.random.default_rng(2)
    for min_words in (1, 2, 5, 8, 15, 40):
        k, among, side = substrings.sizes(min_words)
        assert k + among - 1 == min_words == k + side
        h = rng.integers(0, 1 << 63, 600).astype(np.uint64) * np.uint64(2654435761)
        h[100:160] = h[100]
        at = substrings.beginnings(h, min_words)
        for i in range(len(h) - min_words + 1):
            inside = at[(at >= i) & (at <= i + side)]
            own = substrings.beginnings(h[i : i + min_words], min_words) + i
            assert len(own) == 1 and own[0] in inside
        doc = np.repeat([0, 1, 2], [250, 3, 347])
        parts = [substrings.beginnings(h[doc == d], min_words) + a for d, a in ((0, 0), (1, 250), (2, 253))]
        assert substrings.beginnings(h, min_words, doc).tolist() == np.concatenate(parts).tolist()
    assert len(substrings.beginnings(rng.integers(0, 1 << 63, 9000).astype(np.uint64), 15)) < 9000 / 4


def test_an_insertion_moves_nothing_but_what_is_beside_it():
    rng = random.Random(1)
    words = prose(rng, 3000).encode().split()
    moved = words[:700] + b"inserted words here".split() + words[700:]
    hashes = [np.array([substrings._Hashes()[w] for w in x], dtype=np.uint64) for x in (words, moved)]
    first, other = (set(substrings.beginnings(h, 15).tolist()) for h in hashes)
    assert len({x if x < 690 else x + 3 for x in first} ^ other) <= 8


def test_planted_passages_are_found_and_cut(make_docs):
    rng = random.Random(2)
    passages = [prose(rng, 55) for _ in range(20)]
    texts = []
    for k in range(60):
        parts = [prose(rng, rng.randint(20, 200)), prose(rng, rng.randint(20, 200))]
        if k % 3:
            parts.insert(1, passages[k % 20])
        texts.append(rng.choice((" ", "\n", "  ")).join(parts))
    line = "a common short line that many texts share"
    texts = [f"{t}\n{line}" for t in texts]
    docs = make_docs(texts, CLASH)
    found = {r["doc_id"]: r for r in substrings.shared_documents(docs).collect()}
    assert set(found) == {k + 1 for k in range(60) if k % 3}
    cut = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs).collect()}
    assert len(cut) == 60
    for k, t in enumerate(texts):
        first = min(j for j in range(60) if j % 3 and j % 20 == k % 20) if k % 3 else None
        if not k % 3 or first == k:
            assert cut[k + 1] == t
        else:
            gone = len(t.split()) - len(cut[k + 1].split())
            assert 15 <= gone <= 60 and cut[k + 1].split()[:15] == t.split()[:15]


def test_exact_copies_leave_the_first(make_docs):
    rng = random.Random(3)
    text = prose(rng, 120)
    docs = make_docs([(5, text), (3, text), (8, text), (9, prose(rng, 120))])
    cut = {r["doc_id"]: r["text"].strip() for r in substrings.remove_repeats(docs).collect()}
    assert cut[3] == text and cut[5] == "" and cut[8] == "" and len(cut[9].split()) == 120


def test_odd_texts_null_ids_and_empty_table(make_docs):
    docs = make_docs([*[(i, t) for i, t in enumerate(ODD)], (None, "word " * 6000), (50, "word " * 6000), (50, "word " * 6000)], CLASH)
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = [r["text"] for r in out.where("doc_id = 0 OR doc_id IS NULL").collect()]
    assert sorted(r is None for r in rows) == [False, True] and sum(len(r.split()) for r in rows if r) < 15  # the row without an id comes after its copy
    assert substrings.shared_documents(docs.limit(0)).count() == 0
    assert [r["doc_id"] for r in substrings.shared_documents(docs).collect()].count(50) == 1


def test_one_other_document_holds_each_passage(make_docs):
    rng = random.Random(4)
    words = prose(rng, 200).split()
    donors = [f"{' '.join(words[i : i + 14])} {prose(rng, 40)}" for i in range(0, 186, 3)]
    docs = make_docs([*donors, " ".join(words)])
    assert {r["doc_id"] for r in substrings.shared_documents(docs).collect()} <= set(range(1, len(donors) + 1))
    assert [r["text"] for r in substrings.remove_repeats(make_docs([donors[0], donors[30], " ".join(words)])).where("doc_id = 3").collect()] == [" ".join(words)]


def covered(texts, min_words=substrings.MIN_WORDS):
    """Brute force: of each text the words that stretches of min_words cover which another text holds, and those that an earlier one holds."""
    words = {k: substrings.words_of((t or "").encode()) for k, t in texts.items()}
    held: dict[tuple, set[int]] = {}
    for k, w in words.items():
        for i in range(len(w) - min_words + 1):
            held.setdefault(tuple(w[i : i + min_words]), set()).add(k)
    shared, gone = {}, {}
    for k, w in words.items():
        for i in range(len(w) - min_words + 1):
            own = held[tuple(w[i : i + min_words])]
            if len(own) > 1:
                shared.setdefault(k, set()).update(range(i, i + min_words))
            if min(own) < k:
                gone.setdefault(k, set()).update(range(i, i + min_words))
    return shared, gone


def found_words(docs, min_words=substrings.MIN_WORDS):
    shared, gone = {}, {}
    for r in substrings._passages(docs, substrings._own(docs, "doc_id", "text"), "text", min_words).collect():
        shared.setdefault(r["doc_id"], set()).update(range(r["a"], r["b"]))
        if r["removable"]:
            assert r["first_doc"] < r["doc_id"]
            gone.setdefault(r["doc_id"], set()).update(range(r["a"], r["b"]))
    return shared, gone


def test_passages_are_what_shared_stretches_cover(make_docs):
    rng = random.Random(5)
    pool = [prose(rng, n) for n in (8, 14, 15, 16, 20, 30, 45, 60, 12)]
    texts = {k: "\n".join(rng.choice((rng.choice(pool), prose(rng, 10))) for _ in range(rng.randint(1, 12))) for k in range(1, 41)}
    texts[41], texts[42] = "x y " * 40, "x y " * 9
    docs = make_docs(list(texts.items()))
    for min_words in (15, 6, 1):
        assert found_words(docs, min_words) == covered(texts, min_words) and covered(texts, min_words)[1]
    words = {}
    for r in substrings.passages(docs).collect():
        raw = texts[r["doc_id"]].encode()[r["start"] : r["end"]]
        assert len(raw.split()) == r["words"] and raw == raw.strip()
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["words"]
    assert words == {k: len(v) for k, v in covered(texts)[0].items()}


def test_words_beside_a_chunk_are_packed_and_read_back():
    rng = np.random.default_rng(3)
    for side in (0, 1, 7, 12):
        short = rng.integers(0, 4096, (50, 2 * side)).astype(np.uint16)
        assert (substrings.unpacked([r.tobytes() for r in substrings.packed(short)], side) == short).all()


def test_hot_chunks_give_what_others_give(make_docs, monkeypatch):
    rng = random.Random(15)
    line = prose(rng, 20)
    texts = {k: " ".join(rng.choice([[prose(rng, 9), line, prose(rng, 9)], [line, prose(rng, 12)], [prose(rng, 3), line[:80], prose(rng, 3)]])) for k in range(1, 60)}
    docs = make_docs(list(texts.items()), CLASH)
    want = covered(texts)
    monkeypatch.setattr(substrings, "HOT_ONE_IN", 1)
    for least in (8, 1, 25):  # all stretches of the hot digests are hot, or some
        monkeypatch.setattr(substrings, "HOT_LEAST", least)
        own = substrings._own(docs, "doc_id", "text")
        hot = substrings.heat(docs.select(own[0].alias("doc_id"), own[1].alias("h"), docs["text"].cast("binary").alias("text")), 15)
        assert len(hot.digests) and found_words(docs) == want
    assert len(hot.keys) < 8 * len(hot.digests)
    twice = make_docs([*texts.items(), *[(k, t) for k, t in texts.items() if k < 9], (None, texts[10])])
    both = lambda found: {k: v for k, v in found.items() if k in texts and k != 10}  # noqa: E731  the tenth has a copy now
    assert both(found_words(twice)[0]) == both(want[0])


def test_recall_on_the_whole_table(spark):
    """Every fifteen words in a row that another document holds are found, and no others."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not here")
    docs = spark.read.parquet(path)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got, want = found_words(docs), covered(texts)
    assert sum(map(len, want[0].values())) > 50_000
    for a, b in zip(got, want):
        n, m = sum(map(len, a.values())), sum(map(len, b.values()))
        both = sum(len(a.get(k, set()) & v) for k, v in b.items())
        assert both == m and both >= 0.9999 * n


def test_texts_that_share_an_id_or_have_none(make_docs):
    rng = random.Random(9)
    passage, other = prose(rng, 40), prose(rng, 300)
    a, b = f"{prose(rng, 30)} {passage} {prose(rng, 20)}", f"{prose(rng, 12)} {passage} {prose(rng, 33)}"
    rows = [(5, a), (5, other), (5, other), (None, b), (None, b), (None, prose(rng, 90)), (9, other)]
    docs = make_docs(rows, CLASH)
    cut = [(r["doc_id"], r["text"]) for r in substrings.remove_repeats(docs).collect()]
    assert len(cut) == 7 and cut.count((5, a)) == 1 and cut.count((5, other)) == 2
    assert [len(t.split()) < substrings.MIN_WORDS for k, t in cut if k == 9] == [True]
    short = [t for k, t in cut if k is None and t.split()[:10] == b.split()[:10]]
    assert len(short) == 2 and all(passage not in t and len(t.split()) < 60 for t in short)
    found = sorted((r["doc_id"] or -1, r["first_doc"] or -1) for r in substrings.shared_documents(docs).collect())
    assert found == [(-1, 5), (5, 5), (5, 5), (9, 5)]
    # Two texts under one id alone: the one with the greater hash gives way.
    cut = [r["text"] for r in substrings.remove_repeats(make_docs([(7, a), (7, b)])).collect()]
    assert sorted(t in (a, b) for t in cut) == [False, True] and sum(passage[40:120] in t for t in cut) == 1


def unspaced(rng, n, kind):
    if kind == "json":
        return ",".join(str(rng.randint(0, 10**6)) for _ in range(n // 7 + 1))[:n]
    if kind == "base64":
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    low, high = {"chinese": (0x4E00, 0x9FA5), "thai": (0x0E01, 0x0E2E)}[kind]
    return "".join(chr(rng.randint(low, high)) for _ in range(n))


def test_passages_without_white_space_are_found_wherever_they_stand(make_docs):
    rng = random.Random(6)
    for kind in ("chinese", "thai", "json", "base64"):
        passage = unspaced(rng, 600, kind)
        texts = [unspaced(rng, 300, kind) + passage + unspaced(rng, 300, kind)]
        texts += [unspaced(rng, n, kind) + passage + unspaced(rng, 300, kind) for n in (1, 7, 53)] + [prose(rng, 30) + " " + passage]
        docs = make_docs([*texts, unspaced(rng, 1500, kind)])
        assert {r["doc_id"] for r in substrings.shared_documents(docs).collect()} == {1, 2, 3, 4, 5}
        cut = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs).collect()}
        assert cut[1] == texts[0] and all(len(texts[k - 1]) - len(cut[k]) > 480 for k in (2, 3, 4, 5))


def test_length_counts_as_words_without_white_space(make_docs):
    rng = random.Random(7)
    for kind, short, enough in (("chinese", 25, 100), ("base64", 60, 240)):
        for n, found in ((short, set()), (enough, {1, 2})):
            passage = unspaced(rng, n, kind)
            docs = make_docs([unspaced(rng, 40, kind) + passage + unspaced(rng, 90, kind), unspaced(rng, 71, kind) + passage])
            assert {r["doc_id"] for r in substrings.shared_documents(docs).collect()} == found
