import os

import numpy as np
import pytest

from shroudline.llm import chroma

MEDIA = "id long, audio binary, sample_rate int"


def melody(seed, notes=64):
    return chroma.render(list(np.random.default_rng(seed).normal(0, 0.12, notes)))


def brute_area(image, x0, x1, y0, y1):
    return image[x0:x1, y0:y1].sum()


def test_filters_equal_plain_sums():
    pcm = np.frombuffer(melody(1), "<i2") / 32768
    image, energy = chroma.chroma(pcm)
    assert image.shape[1] == 12 and np.allclose(image.sum(axis=1), 1, atol=1e-6)
    packed, loud = chroma.fingerprint(pcm)
    assert len(packed) == len(image) - chroma.WIDTH + 1 and all(loud)
    for at in (0, 17, len(packed) - 1):
        bits = 0
        for kind, low, height, width in chroma.filters():
            high, mid, half = low + height, low + height // 2, width // 2
            area = lambda x0, x1, y0, y1: brute_area(image, at + x0, at + x1, y0, y1)  # noqa: B023, E731
            whole = area(0, width, low, high)
            a = (area(0, width, mid, high), area(half, width, low, high), area(0, half, low, mid) + area(half, width, mid, high), area(width // 4, width - width // 4, low, high))[kind]
            level = int(np.digitize(np.log((1 + a) / (1 + whole - a)), chroma.LEVELS))
            bits = bits << 2 | level ^ level >> 1
        assert bits == packed[at] & 0xFFFFFFFF


def test_excerpts_are_found_at_their_place(spark):
    media = spark.createDataFrame([(i, melody(i % 40), chroma.RATE) for i in range(60)], MEDIA)
    fps = chroma.fingerprints(media)
    asked = chroma.fingerprints(media.where("id < 20"), decode=chroma.excerpt)
    rows = chroma.align(fps, asked).collect()
    assert {r["query_id"] for r in rows} == {r["match_id"] for r in rows} and len(rows) >= 19
    assert all(r["query_id"] == r["match_id"] and r["offset"] == 24 and r["n_copies"] == 2 and r["bit_error"] < 0.15 for r in rows)
    # Brute force: the bit error over all offsets of all pairs has its least value there, and no other pair comes near.
    table = {r["id"]: np.array(r["fp"], np.int32) for r in fps.collect()}
    for q in asked.where("id < 5").collect():
        a = np.array(q["fp"], np.int32)
        best = sorted((chroma.bit_error(a, b, o)[0], i, o) for i, b in table.items() if i < 40 for o in range(-40, 80) if chroma.bit_error(a, b, o)[1] >= 24)
        assert best[0][1:] == (q["id"], 24) and best[1][0] > chroma.MAX_BIT_ERROR or best[1][1] == q["id"]


def test_recall_over_the_tables_with_short_and_long_lists(spark):
    data = "/root/testdata/sf0.1"
    if not os.path.isdir(data):
        pytest.skip("the driver's tables are not here")
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding")
    asked = chroma.fingerprints(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", None, lambda k, v: chroma.excerpt(k, chroma.render(v))).cache()
    fps = chroma.fingerprints(vectors, "vec_id", "embedding", None, lambda _, v: chroma.render(v)).cache()
    copies = {r["id"]: r["rep"] for r in fps.join(fps.groupBy("fp", "loud").agg({"id": "min"}).withColumnRenamed("min(id)", "rep"), ["fp", "loud"]).select("id", "rep").collect()}
    ids = {r["id"] for r in asked.collect()}
    for long_list in (chroma.LONG_LIST, 3):  # with 3 most integers are looked up together with the next ones
        rows = chroma.align(fps, asked, long_list=long_list).collect()
        found = {r["query_id"] for r in rows if r["match_id"] == copies[r["query_id"]] and r["offset"] == 24}
        assert len(found) >= 0.95 * len(ids), (long_list, len(found), len(ids))


def test_meetings_with_any_list_length_keep_what_agrees_for_long(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(0, 3, 60)], [True] * 60) for i in range(12)]
    fps = spark.createDataFrame(rows, "id long, fp array<int>, loud array<boolean>")
    classes = chroma._classes(fps)
    plain = {tuple(r) for r in chroma.meetings(chroma._postings(classes), chroma._postings(classes), 10**9).collect()}
    fine = {tuple(r) for r in chroma.meetings(chroma._postings(classes), chroma._postings(classes), 5).collect()}
    looked = {i: chroma.looked_up(np.array(fp), np.array(loud)) for i, fp, loud in rows}
    value = {i: fp for i, fp, _ in rows}
    assert plain == {(q, a, r, b) for q in value for r in value for a in looked[q] for b in looked[r] if value[q][a] == value[r][b]}

    def ahead(i, at):
        k = looked[i].index(at)
        return [value[i][p] for p in looked[i][k : k + chroma.AHEAD]]

    assert {m for m in plain if ahead(m[0], m[1]) == ahead(m[2], m[3])} <= fine < plain


def test_steady_audio_is_found(spark):
    t = np.arange(20 * chroma.RATE) / chroma.RATE
    sounds = [sum(np.sin(2 * np.pi * hz * t) for hz in chord) * 16000 / len(chord) for chord in ((220.0, 277.2, 329.6), (440.0,), (196.0, 246.9))]
    media = spark.createDataFrame([(i, s.astype("<i2").tobytes(), chroma.RATE) for i, s in enumerate(sounds)] + [(10 + i, melody(i), chroma.RATE) for i in range(10)], MEDIA)
    rows = chroma.align(chroma.fingerprints(media), chroma.fingerprints(media.where("id < 3"), decode=chroma.excerpt)).collect()
    # Steady sounds may share a fingerprint; a class is named by its smallest id.
    assert {r["query_id"] for r in rows} == {0, 1, 2} and all(r["match_id"] <= r["query_id"] and r["bit_error"] < 0.05 for r in rows)


def test_odd_media(spark):
    silent = np.zeros(20000, "<i2").tobytes()
    media = spark.createDataFrame([(1, None, None), (2, b"", 8000), (3, b"abc", 8000), (4, silent, chroma.RATE), (5, silent, chroma.RATE), (None, melody(1), chroma.RATE), (6, melody(2), None), (6, melody(2), None)], MEDIA)
    fps = chroma.fingerprints(media)
    assert fps.count() == 8
    rows = chroma.align(fps, fps).collect()
    assert {(r["query_id"], r["match_id"], r["n_copies"]) for r in rows} == {(6, 6, 2)}
    assert chroma.align(fps.limit(0), fps).count() == 0 and chroma.align(fps, fps.limit(0)).count() == 0


def test_another_rate_gives_nearly_the_same(spark):
    pcm = np.frombuffer(melody(3), "<i2") / 32768
    fast = np.repeat(pcm, 4)
    a, b = (np.array(chroma.fingerprint(x, r)[0], np.int32) for x, r in ((pcm, chroma.RATE), (fast, 4 * chroma.RATE)))
    assert chroma.bit_error(a, b, 0)[0] < 0.05


def brute_votes(table, min_votes=chroma.MIN_VOTES):
    """Best offset and votes of every pair of the recordings (id: (fp, loud)), every meeting counted by itself."""
    looked = {i: chroma.looked_up(np.array(fp), np.array(loud)) for i, (fp, loud) in table.items()}
    out = {}
    for q in table:
        for r in table:
            votes = {}
            for a in looked[q]:
                for b in looked[r]:
                    if table[q][0][a] == table[r][0][b]:
                        votes[b - a] = votes.get(b - a, 0) + 1
            best = max(((n, -abs(o), o) for o, n in votes.items() if n >= min_votes), default=None)
            if best:
                out[q, r] = (best[2], best[0])
    return out


def scattered(seed=5, pairs=8, windows=60):
    """Pairs of recordings that agree in every fifth integer, all of them common, and differ by a few bits between."""
    rng, table = np.random.default_rng(seed), {}
    for i in range(pairs):
        fp = rng.integers(0, 1 << 30, windows)
        fp[::5] = rng.integers(0, 2, len(fp[::5]))
        other = np.where(np.arange(windows) % 5 == 0, fp, fp ^ (1 << rng.integers(0, 30, windows)))
        table |= {2 * i: ([int(x) for x in fp], [True] * windows), 2 * i + 1: ([int(x) for x in other], [True] * windows)}
    return table


def test_votes_of_common_integers_are_all_counted(spark):
    table = scattered()
    # Recordings in which the two integers are as common as in the others, so that the list of each has over LONG_LIST windows.
    rng = np.random.default_rng(6)
    table |= {100 + i: ([int(x) for x in np.where(np.arange(60) % 2, rng.integers(0, 2, 60), rng.integers(0, 1 << 30, 60))], [True] * 60) for i in range(30)}
    assert min(sum(fp[p] == x for fp, loud in table.values() for p in chroma.looked_up(np.array(fp), np.array(loud))) for x in (0, 1)) > chroma.LONG_LIST
    fps = spark.createDataFrame([(i, *row) for i, row in table.items()], "id long, fp array<int>, loud array<boolean>")
    classes = chroma._classes(fps)
    want = brute_votes(table)
    for block in (chroma.BLOCK, 100):
        assert {(r["q"], r["rep"]): (r["offset"], r["votes"]) for r in chroma.exact_votes(classes, classes, chroma.MIN_VOTES, block).collect()} == want
    found = {(r["query_id"], r["match_id"]) for r in chroma.align(fps, fps.where("id < 16")).collect()}
    assert {(i, i ^ 1) for i in range(16)} <= found
    errors = {p: chroma.bit_error(*(np.array(table[i][0], np.int32) for i in p), want[p][0]) for p in want if p[0] < 16}
    assert found == {p for p, (error, n) in errors.items() if n >= chroma.MIN_OVERLAP and error <= chroma.MAX_BIT_ERROR}
    # The bounded way loses pairs whose neighbouring integers differ.
    assert len(chroma.align(fps, fps.where("id < 16"), long_list=chroma.LONG_LIST).collect()) < len(found)


def test_meetings_are_counted_in_steps_of_any_size():
    table = scattered(7, 5, 40) | {50: ([3] * 400, [True] * 400), 51: ([3] * 300 + [0, 1] * 20, [True] * 340)}
    want = brute_votes(table)
    names = sorted(table)
    windows = [np.array(x) for x in zip(*((names.index(i), p, table[i][0][p]) for i in names for p in chroma.looked_up(np.array(table[i][0]), np.array(table[i][1]))))]
    for step in (chroma.STEP, 500, 7, 1):
        got = chroma.best_offsets(chroma.by_integer(*windows), windows, chroma.MIN_VOTES, step)
        assert {(names[q], names[r]): (o, n) for q, r, o, n in zip(*(x.tolist() for x in got))} == want
    assert not len(chroma.best_offsets(chroma.by_integer(*[x[:0] for x in windows]), windows, 3)[0]) and not len(chroma.best_offsets(chroma.by_integer(*windows), [x[:0] for x in windows], 3)[0])
