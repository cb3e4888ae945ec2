import random

import corpus_pipeline
from shroudline.llm import packing, pii, simhash, substrings

from .conftest import CLASH
from .test_substrings import prose


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(8)
    passage = prose(rng, 60)
    texts = []
    for i in range(80):
        text = prose(rng, 150)
        if i % 4 == 0:
            text = f"{text} {passage} {prose(rng, 40)}"
        if i % 5 == 0:
            text += " grunk zweeny grunk blorted zweeny"
        if i % 7 == 0:
            text += " write to a@b.de"
        texts.append(text)
    texts += [texts[1], texts[1], texts[2] + " more", None, "", "  "]
    rows = [(i + 1, t, "en", None if i == 3 else "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    labels = [(i + 1, 1, int(i % 5 == 0)) for i in range(80)]
    sf = str(tmp_path)
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        docs = docs.withColumn(c, F.lit(1))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    out, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, sf).write.parquet(f"{sf}/out-{k}")
        out = spark.read.parquet(f"{sf}/out-{k}")
        seen.append(out)
        if name != "packing":
            assert out.columns == docs.columns
    toxic, near, cut, masked, packed = seen
    left = {r["doc_id"] for r in toxic.collect()}
    assert not left & set(range(1, 81, 5)) and len(left) >= 66
    # Near duplicates against brute force: one row of each group, the smallest id.
    fps = {r["doc_id"]: simhash.fingerprint(r["text"] or "") for r in toxic.collect()}
    from .test_simhash import brute_components

    assert {r["doc_id"] for r in near.collect()} == set(brute_components(fps).values())
    texts_at = [{r["doc_id"]: r for r in df.collect()} for df in (near, cut, masked)]
    assert set(texts_at[0]) == set(texts_at[1]) == set(texts_at[2])
    shared = {r["doc_id"] for r in substrings.shared_documents(near).collect()}
    for i, r in texts_at[1].items():
        if i not in shared:
            assert r["text"] == texts_at[0][i]["text"]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert sum(passage[100:200] in (r["text"] or "") for r in texts_at[1].values()) <= 1
    for i, r in texts_at[2].items():
        before = texts_at[1][i]["text"]
        assert ("[EMAIL]" in (r["text"] or "")) == bool(pii.base_spans(before or ""))
    rows = [tuple(r) for r in packed.collect()]
    from .test_packing import check, want

    check(rows, {i: want(r["text"]) for i, r in texts_at[2].items()}.__getitem__)
    assert {r[0] for r in rows} == set(texts_at[2])
    whole = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert {k[0] for k in key(whole)} == {r[0] for r in rows}
    assert sum(k[2] for k in key(whole)) == sum(r[2] for r in rows)
    assert packing.pack(docs.limit(0)).count() == 0
