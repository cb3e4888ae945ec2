import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shroudline.llm import quality

from .conftest import CLASH, ODD


def brute(text):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [s for s in text.split("\n") if word.search(s)]
    dup = sum(s in lines[:i] for i, s in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def counts(text):
    words, hashes = quality.split_words(text.encode())
    return quality.base_counts(text, words, hashes)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#|é\r"), max_size=150))
def test_base_counts_equal_brute_force(text):
    assert counts(text) == brute(text)


def test_base_counts_of_repetition():
    for text in ("a b c d e f g h " * 5, "x " * 30, "one two\none two\n\n \none two", " ".join(map(str, range(50))) * 2, "a b c d e f g h i a b c d e f g h"):
        assert counts(text) == brute(text)


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    words = ["tion", "reha", "stand", "house", "river", "green", "walk", "paper", "light", "stone"]
    rows, labels = [], []
    for i in range(1, n + 1):
        good = int(rng.random() < 0.7)
        text = [rng.choice(words) + (rng.choice(("", "!!", "%%%", "$$$")) if not good else "") for _ in range(rng.randint(20, 90))]
        rows.append((i, " ".join(text)))
        labels.append((i, good, 0))
    return rows, labels


def test_model_is_right_and_calibrated_on_held_out_rows(spark, make_docs):
    from shroudline.llm.common import held_out

    rows, labels = corpus()
    docs, table = make_docs(rows, CLASH), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(docs, table)
    truth = {i: q for i, q, _ in labels}
    got = [(r["probability"], truth[r["doc_id"]], r["kept"], r["base_failed"]) for r in quality.score(docs, model).where(held_out("doc_id")).collect()]
    assert sum((p >= 0.5) == (q == 1) for p, q, *_ in got) / len(got) > 0.97
    assert abs(sum(p for p, *_ in got) / len(got) - sum(q for _, q, *_ in got) / len(got)) < 0.1
    assert all(k == (not f and p >= 0.5) for p, _, k, f in got)


def test_odd_texts_and_no_labels(spark, make_docs):
    docs = make_docs([*ODD, (None, "a b")], CLASH)
    model = quality.learn(docs, spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert model.weights is None
    rows = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(rows) == len(ODD) + 1
    assert rows[1]["n_words"] == 0 and rows[1]["base_failed"] and not rows[1]["kept"]
    assert rows[5]["n_words"] == rows[5]["n_repeat_words"] == 6000 and rows[6]["word_chars"] == 30000
    assert quality.score(docs.limit(0), model).count() == 0


def test_vectors_and_probabilities_equal_plain_counts():
    rng = random.Random(4)
    model = quality.Model(np.random.default_rng(0).normal(size=quality.BUCKETS), 2.0, -0.5)
    for _ in range(20):
        text = "".join(rng.choice("ab é\n!") for _ in range(rng.randint(0, 60)))
        raw = text.encode()
        words, hashes = quality.split_words(raw)
        shift, u32 = 32 - quality.BUCKETS.bit_length() + 1, 2**32
        plain = Counter()
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                code = int.from_bytes(raw[i : i + n], "big")
                plain[(code * 2654435761 + n * 40503) % u32 * 2246822519 % u32 >> shift] += 1
        h = [zlib.crc32(w) for w in words]
        for a in h:
            plain[a * 3266489917 % u32 >> shift] += 1
        for a, b in zip(h, h[1:]):
            plain[(a * 668265263 + b) % u32 * 374761393 % u32 >> shift] += 1
        logs = {k: math.log1p(v) for k, v in plain.items()}
        norm = math.sqrt(sum(v * v for v in logs.values())) or 1.0
        x = quality.vector(raw, hashes)
        assert all(abs(x[k] - v / norm) < 1e-9 for k, v in logs.items()) and np.count_nonzero(x) == len(logs)
        z = 2.0 * sum(v / norm * model.weights[k] for k, v in logs.items()) - 0.5
        assert abs(model.probability(x[None])[0] - 1 / (1 + math.exp(-z))) < 1e-9


def test_a_rare_class_still_gives_a_model(spark, make_docs):
    rows, labels = corpus(300)
    few = [(i, q, 0) for i, q, _ in labels if q or i % 23 == 0]
    model = quality.learn(make_docs(rows), spark.createDataFrame(few, "doc_id long, quality int, toxic int"))
    assert model.weights is not None
    bad = [r["kept"] for r in quality.score(make_docs([(i, t) for (i, t), (_, q, _) in zip(rows, labels) if not q]), model).collect()]
    assert sum(bad) < 0.2 * len(bad)
