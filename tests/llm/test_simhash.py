import random

import xxhash

from shroudline.llm import simhash

from .conftest import CLASH, ODD


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def near_texts(n=120, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        out.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 3))):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_groups_equal_brute_force(make_docs):
    texts = [*ODD, *near_texts()]
    docs = make_docs(texts, CLASH)
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = {i + 1: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    assert len(set(want.values())) < len(want)
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_long_lists_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_LIST", 4)
    rng = random.Random(1)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 60:  # a chain of small steps away from one fingerprint, and noise
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(40)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links)
    from shroudline.llm.components import components

    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} if links else {}
    want = brute_components({x: x & (2**64 - 1) for x in signed})
    for a in signed:
        for b in signed:
            assert (want[a] == want[b]) == (found.get(a, a) == found.get(b, b))


def test_masks_leave_no_pair_out():
    rng = random.Random(2)
    for _ in range(500):
        diff = 0
        for _ in range(3):
            diff |= 1 << rng.randrange(64)
        masks = [m for m in simhash.first_masks() if not diff & m]
        assert masks
        for _ in range(4):
            finer = [f for f in simhash.finer_masks(masks[0]) if not diff & f]
            assert finer
            masks = finer
        assert 64 - masks[0].bit_count() <= 14


def test_null_ids_repeated_rows_and_empty_table(spark, make_docs):
    docs = make_docs([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "other words here now"), (None, "alone only once")])
    rows = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert rows == [(0, 0), (0, 4), (4, 4), (4, 4), (9, 9)]
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "alone only once"), (4, "a b c"), (9, "other words here now")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_texts_that_share_an_id_or_have_none_are_told_apart(make_docs):
    rows = [(None, "a b c d")] * 5 + [(None, "quite another text than that")] * 3 + [(4, "first text of the id four"), (4, "second words under an id"), (6, "second words under an id"), (4, "first text of the id four")]
    docs = make_docs(rows, CLASH)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "a b c d"), (0, "quite another text than that"), (4, "first text of the id four"), (4, "second words under an id")]


def test_a_hot_fingerprint_is_joined_whole(spark, make_docs, monkeypatch):
    from shroudline.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 0.1)
    docs = make_docs([(i, "the same text as many others") for i in range(60)] + [(100 + i, f"text {i} of its own kind {i * 7}") for i in range(30)])
    rows = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(rows) == 90 and all(rows[i] == 0 for i in range(60)) and all(rows[100 + i] >= 100 for i in range(30))


def test_components_of_a_long_chain_and_a_star(spark):
    from shroudline.llm.components import components

    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({found[i] for i in range(301)}) == 1 and len({found[i] for i in range(1000, 1200)}) == 1
    assert found[0] != found[1000] and len(found) == 501
