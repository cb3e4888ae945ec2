import os
import random
import zlib

import pytest

from shroudline.llm import toxicity
from shroudline.llm.common import held_out

from .conftest import CLASH, ODD


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = ["tion", "reha", "stand", "house", "river", "green", "walk", "paper", "light", "stone", "gretel", "moving"]
    bad = ["grunk", "blorted", "zweeny"]
    rows, labels = [], []
    for i in range(1, n + 1):
        text = [rng.choice(words) for _ in range(rng.randint(10, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(1 + len(text) // 25):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_fold():
    assert toxicity.fold("GRUNK, grуnk!").split() == ["grunk", "grynk"]
    assert toxicity.fold("bl0rt3d 5tand w1ndow1 1999 $$$word$$$").split() == ["blorted", "stand", "windowi", "ssswort"[:3] + "word"]
    assert toxicity.fold("gr​unk").split() == ["grunk"]
    assert toxicity.fold("Réeux ÀB").split() == ["réeux", "àb"]


def test_learned_lexicon_finds_held_out_texts(spark, make_docs):
    rows, labels = corpus()
    docs, table = make_docs(rows, CLASH), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, table)
    assert {" grunk ", " blorted ", " zweeny "} & set(lexicon.weights) or any(" grunk ".startswith(e) for e in lexicon.weights)
    scored = toxicity.score_documents(docs, lexicon).withColumn("held", held_out("doc_id"))
    truth = {i: t for i, _, t in labels}
    held = [(r["score"] >= 0.5, bool(truth[r["doc_id"]])) for r in scored.where("held").collect()]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    score = lexicon.scorer()
    assert score("house river GRUNK grunk bl0rted green") > 0.5 > score("house river green walk")
    kept = toxicity.reject_toxic(docs, lexicon)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in scored.where("score < 0.5").collect()}


def test_held_out_labels_change_nothing(spark, make_docs):
    rows, labels = corpus()
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.learn(make_docs(rows), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert a == b


def test_exception_phrases_are_spared():
    lexicon = toxicity.Lexicon({" clown ": 5.0, " clow": 4.0}, ("clown fish",))
    features = lexicon.matcher()
    assert features("a clown fish swims")[2] == 0
    assert features("a clown and a clown fish")[2] == 1
    assert features("a clown")[0] == 250.0


def test_exception_phrases_are_learned_from_clean_rows_and_act_on_others(spark, make_docs):
    """A word that toxic texts have is harmless beside another one."""
    rows, labels = corpus(seed=4)
    rng, out = random.Random(5), []
    for (i, text), (_, _, toxic) in zip(rows, labels):
        words = text.split()
        if not toxic and i % 17 == 0:
            words[rng.randrange(len(words)) : 0] = ["zweeny", "river"]
        out.append((i, " ".join(words).replace("zweeny zweeny river", "zweeny river") if not toxic else text.replace("zweeny river", "zweeny")))
    lexicon = toxicity.learn(make_docs(out), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), exceptions=("trash can",))
    assert "zweeny river" in lexicon.exceptions and "trash can" in lexicon.exceptions
    toxic_texts = [toxicity.fold(t).split() for (i, t), (_, _, y) in zip(out, labels) if y and zlib.crc32(str(i).encode()) % 5]
    assert not any(f"{a} {b}" in lexicon.exceptions for words in toxic_texts for a, b in zip(words, words[1:]))
    plain = toxicity.Lexicon(lexicon.weights, (), lexicon.coef)
    held = [t for (i, t), (_, _, y) in zip(out, labels) if not y and i % 17 == 0 and zlib.crc32(str(i).encode()) % 5 == 0]
    ours, without = lexicon.matcher(), plain.matcher()
    assert len(held) >= 2 and all(ours(t)[2] < without(t)[2] for t in held)
    assert lexicon.scorer()("green house zweeny river walk stone") < 0.5 < lexicon.scorer()("green house zweeny zweeny walk stone")


def test_learned_phrases_act_on_held_out_documents(spark):
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.where(held_out("doc_id")).collect() if r["toxic"] is not None}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where(held_out("doc_id")).select("doc_id", "text").collect() if r["doc_id"] in truth}
    ours, without, score = lexicon.matcher(), toxicity.Lexicon(lexicon.weights, ()).matcher(), lexicon.scorer()
    acted = [i for i, t in texts.items() if ours(t)[2] < without(t)[2]]
    assert len(acted) >= 20 and sum(truth[i] == 0 for i in acted) > 0.9 * len(acted)
    assert sum((score(t) >= 0.5) == bool(truth[i]) for i, t in texts.items()) > 0.985 * len(texts)


def test_matcher_equals_a_plain_scan():
    rng = random.Random(7)
    stems = ["ab", "abc", "bca", "cab", "bb", "cc"]
    for _ in range(300):
        weights = {rng.choice((f" {w} ", f" {w}")): rng.choice((1.0, 2.0, 3.0)) for w in rng.sample(stems, 4)}
        phrases = tuple({" ".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(3)})
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 30))]
        text = f" {' '.join(words)} "
        spared = set()
        for p in phrases:
            for at in range(len(text)):
                if text.startswith(f" {p} ", at):
                    spared |= set(range(at, at + len(p) + 1))
        best = {}
        for at in range(len(text)):
            found = [w for e, w in weights.items() if text.startswith(e, at) and f" {e.strip()} " not in {f" {p} " for p in phrases}]
            if found and at not in spared:
                best[at] = max(found)
        got = toxicity.Lexicon({e: w for e, w in weights.items() if f" {e.strip()} " not in {f" {p} " for p in phrases}}, phrases).matcher()(" ".join(words))
        if any(f" {e.strip()} " not in {f" {p} " for p in phrases} for e in weights):
            assert got[2] == len(best) and abs(got[0] - sum(best.values()) * 100 / len(words)) < 1e-9


def test_long_texts_with_many_spared_phrases_take_no_longer_than_their_length():
    lexicon = toxicity.Lexicon({" clown ": 5.0}, ("clown fish",))
    assert lexicon.matcher()("a clown fish " * 200_000 + "clown")[2] == 1


def test_the_lexicon_has_as_many_entries_as_the_rows_give(spark, make_docs):
    rng, bad = random.Random(3), [f"zz{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q" for i in range(2000)]
    rows, labels = [], []
    for i in range(1, 301):
        toxic = i % 2
        rows.append((i, " ".join(rng.sample(bad, 400) if toxic else ["house", "river"] * 30)))
        labels.append((i, 1, toxic))
    lexicon = toxicity.learn(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    machine = lexicon.matcher()
    assert all(machine(w)[2] == 1 for w in bad)


def test_odd_texts_and_no_labels(spark, make_docs):
    docs = make_docs([*ODD, (None, "grunk")], CLASH)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, none)
    assert [r["score"] for r in toxicity.score_documents(docs, lexicon).collect()] == [0.0] * (len(ODD) + 1)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (99999, 1, 1), (7, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    toxicity.learn(docs, odd)
    rows, labels = corpus(n=100)
    lexicon = toxicity.learn(make_docs(rows), spark.createDataFrame(labels * 2, "doc_id long, quality int, toxic int"))
    assert toxicity.score_documents(docs, lexicon).count() == len(ODD) + 1
    assert toxicity.score_documents(docs.limit(0), lexicon).count() == 0
