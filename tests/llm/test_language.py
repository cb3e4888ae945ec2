import random

import numpy as np

from shroudline.llm import language
from shroudline.llm.common import held_out

from .conftest import CLASH, ODD

SYLLABLES = {"aa": ["tion", "the", "ing", "reh"], "bb": ["keit", "sch", "ung", "und"], "cc": ["eux", "que", "oi", "les"]}


def corpus(spark, n=240, seed=2):
    from pyspark.sql import functions as F

    rng, rows = random.Random(seed), []
    for i in range(1, n + 1):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 80)))
        rows.append((i, rng.choice((text, text.upper())), lang if rng.random() < 0.9 else None, lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    for c in CLASH:
        df = df.withColumn(c, F.lit(1))
    return df


def test_kernel_is_that_of_shared_grams():
    a, b = language.present("the thing"), language.present("THE  ring!")
    k = language.Kernel(["x"], b[None].astype(np.float32) / np.sqrt(b.sum()), np.zeros((2, 1)))
    assert abs(k.similarities(a[None])[0, 0] - (a & b).sum() / np.sqrt(a.sum() * b.sum())) < 1e-6
    grams = {g for n in (1, 2, 3) for g in (" the thing "[i : i + n] for i in range(11 - n + 1))}
    assert len(grams) - 2 <= a.sum() <= len(grams)


def test_held_out_languages_are_right(spark):
    docs = corpus(spark)
    kernel = language.learn(docs, n_landmarks=24)
    got = language.identify(docs, kernel).join(docs.select("doc_id", "truth"), "doc_id").where(held_out("doc_id")).collect()
    assert got and sum(r["lang_pred"] == r["truth"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    docs = corpus(spark)
    other = docs.withColumn("lang", F.when(held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    a, b = language.learn(docs), language.learn(other)
    assert a.languages == b.languages and np.allclose(a.coef, b.coef)


def test_odd_texts_and_nothing_learned(spark, make_docs):
    docs = make_docs([*ODD, (None, "abc")], CLASH)
    kernel = language.learn(corpus(spark))
    rows = {r["doc_id"]: r for r in language.identify(docs, kernel).collect()}
    assert len(rows) == len(ODD) + 1
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert all(rows[i]["lang_pred"] in SYLLABLES for i in (5, 6, 7, 8, None))
    from pyspark.sql import functions as F

    assert language.learn(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.limit(0), kernel).count() == 0


def test_letters():
    assert not any(map(language.has_letter, ("", "½ ² 12 _", "!?", "①", "٣", " \n")))
    assert all(map(language.has_letter, ("½ a", "é", "漢", "１ª", "12_x")))


def test_three_hundred_languages_are_all_learned(spark, make_docs):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(300 * 4)]
    rows = [(k, " ".join(rng.choice(words[4 * (k % 300) : 4 * (k % 300) + 4]) for _ in range(40))) for k in range(2400)]
    docs = make_docs(rows).withColumn("lang", F.format_string("l%03d", F.col("doc_id") % 300))
    kernel = language.learn(docs)
    assert len(kernel.languages) == 300 and len(kernel.landmarks) >= 300
    got = language.identify(docs, kernel).join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id")).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.9


def test_rows_that_share_an_id_keep_their_languages(spark, make_docs):
    from pyspark.sql import functions as F

    a = make_docs([(7, "tion the ing reh " * 5 + str(i)) for i in range(200)]).withColumn("lang", F.lit("aa"))
    b = make_docs([(7, "keit sch ung und " * 5 + str(i)) for i in range(200)] + [(8 + i, "keit sch ung und") for i in range(20)]).withColumn("lang", F.lit("bb"))
    kernel = language.learn(a.union(b))
    assert kernel.languages == ["aa", "bb"] and len(kernel.landmarks) < 30
    got = {r["lang_pred"] for r in language.identify(a, kernel).collect()}
    assert got == {"aa"}


def test_predictions_equal_plain_kernel_ridge(spark):
    """With every learned document as a landmark the Nyström solution is that of kernel ridge regression on all of them."""
    docs = corpus(spark, n=120)
    kernel = language.learn(docs, n_landmarks=10**6)
    rows = sorted({(r["lang"], r["text"]) for r in docs.where(~held_out("doc_id") & docs.lang.isNotNull()).collect()})
    x = np.array([language.present(t) for _, t in rows]).astype(float)
    unit = x / np.sqrt(x.sum(axis=1))[:, None]
    gram = unit @ unit.T
    y = np.where(np.array([lang for lang, _ in rows])[:, None] == np.array(kernel.languages), 1.0, -1.0)
    lam = language.RIDGE * len(rows) / 100
    # min |y - b - K a|^2 + lam a'Ka, the offset b free
    n = len(rows)
    system = np.block([[gram + lam * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.vstack([y, np.zeros((1, y.shape[1]))]))
    fresh = [r["text"] for r in docs.where(held_out("doc_id")).collect()]
    z = np.array([language.present(t) for t in fresh]).astype(float)
    want = (z / np.sqrt(z.sum(axis=1))[:, None]) @ unit.T @ solved[:n] + solved[n]
    got = np.column_stack([np.ones(len(z)), kernel.similarities(z)]) @ kernel.coef
    assert np.abs(want - got).max() < 0.02 and (want.argmax(axis=1) == got.argmax(axis=1)).all()
