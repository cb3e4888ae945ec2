import hashlib
import math
import random

import numpy as np
import pytest

from shroudline.llm import codes

from .conftest import CLASH

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=6):
    """rows: (vec_id, vector, label), all usable and of equal length, a multiple of eight."""
    rows = sorted(rows, key=lambda r: r[0])
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    width = len(ints[0]) // 8
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for v in ints[:16]] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((dist(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(8):
            own = [nearest(v, p)[1] for v in ints]
            for k in range(len(books[p])):
                members = [part(v, p) for v, o in zip(ints, own) if o == k]
                if members:
                    books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    found = [[nearest(v, p) for p in range(8)] for v in ints]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), error in zip(rows, errors):
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {(i, "".join(f"{k:02x}" for _, k in f), e, by_label[label]) for (i, _, label), f, e in zip(rows, found, errors)}, digest


def vectors(n, dims=16, seed=0, coarse=False):
    rng = random.Random(seed)
    one = (lambda: rng.choice([-1.0, 0.0, 0.5])) if coarse else (lambda: rng.gauss(0, 0.3))
    return [(k, [one() for _ in range(dims)], rng.choice([None, 1, 2, 3])) for k in range(n)]


def result(df):
    return {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in df.collect()}


@pytest.mark.parametrize("rows", [vectors(200), vectors(150, coarse=True, seed=1), vectors(7, seed=2), vectors(40, dims=64, seed=3)])
def test_codes_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASH:
        df = df.withColumn(name, codes.F.lit(7))
    got, book = codes.encode(df.repartition(3))
    want, digest = brute(rows)
    assert result(got) == want
    assert codes.digest(book) == digest


def test_partial_distances_give_the_first_of_the_nearest():
    rng = np.random.default_rng(4)
    for high in (2, 50):
        x, book = rng.integers(-high, high, (300, 8)), rng.integers(-high, high, (16, 8))
        full = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        code, best = codes.search_part(x, book)
        assert (code == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


def test_unusable_vectors_are_left_out(spark):
    rows = vectors(30)
    bad = [(100, None, 1), (101, [None] + [0.0] * 15, 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] + [0.0] * 15, None), (104, [float("-inf")] * 16, 2)]
    got, book = codes.encode(spark.createDataFrame(rows + bad, SCHEMA))
    want, digest = brute(rows)
    assert result(got) == want and codes.digest(book) == digest


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [0.5] * 9, None), (None, [], None), (2, [3e38] * 16, 5), (3, [-3e38] * 16, 5)]
    got, book = codes.encode(spark.createDataFrame(rows, SCHEMA))
    assert book.shape == (8, 6, 2) and got.count() == 6 and abs(book).max() == codes.MOST
    empty, book = codes.encode(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and codes.digest(book) == hashlib.sha256(b"").hexdigest()
