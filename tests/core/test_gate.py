"""Documents are published one by one, once."""

import os

import pytest
from pyspark.sql import functions as F

from shroudline.plans import run as plan
from shroudline.sources import corpus, gate, rulepacks

LEAKS = "array<struct<page:int,kind:string,detail:string>>"


@pytest.fixture
def staged(spark):
    """Five documents of two pages; the third has a leak on its second page."""
    rows = [(d, p, f"text {d} {p}", [(p, "overlay", "seen")] if (d, p) == (3, 2) else []) for d in range(1, 6) for p in (1, 2)]
    return spark.createDataFrame(rows, f"doc_id long, page int, text string, leaks {LEAKS}").repartition(4)


def ids(df):
    return sorted((r["doc_id"], r["page"]) for r in df.collect())


def test_a_leak_holds_back_its_own_document(spark, staged, tmp_path):
    path = str(tmp_path / "out")
    done = gate.publish(staged, path)
    assert (done["n_data"], done["n_held"]) == (4, 1)
    assert ids(gate.read(spark, path)) == [(d, p) for d in (1, 2, 4, 5) for p in (1, 2)]
    assert "leaks" not in gate.read(spark, path).columns
    held = gate.read(spark, path, "held").collect()
    assert [(r["doc_id"], [tuple(x) for x in r["leaks"]]) for r in held] == [(3, [(2, "overlay", "seen")])]


def test_a_check_that_breaks_holds_back_its_own_document(spark, staged, tmp_path):
    def check(document):
        if document.column("doc_id")[0].as_py() == 2:
            raise RuntimeError("unreadable")
        return []

    path = str(tmp_path / "out")
    done = gate.publish(staged, path, check=check)
    assert (done["n_data"], done["n_held"]) == (4, 1)
    row = gate.read(spark, path, "held").first()
    assert (row["doc_id"], row["leaks"][0]["kind"], row["leaks"][0]["detail"]) == (2, "broken", "RuntimeError: unreadable")


def test_a_run_counts_once(spark, staged, tmp_path):
    path = str(tmp_path / "out")
    assert gate.publish(staged, path, run_id="a") == gate.publish(staged, path, run_id="a")
    assert gate.read(spark, path).count() == 8
    gate.publish(staged.where("doc_id = 1"), path, run_id="b")
    assert gate.read(spark, path).count() == 10
    gate.publish(staged.where("doc_id = 5"), path, run_id="c", overwrite=True)
    assert ids(gate.read(spark, path)) == [(5, 1), (5, 2)]
    gone = gate.sweep(spark, path)
    assert gone > 0 and gate.sweep(spark, path) == 0
    assert ids(gate.read(spark, path)) == [(5, 1), (5, 2)]


def test_a_run_that_breaks_publishes_nothing_and_can_be_done_again(spark, staged, tmp_path):
    path, flag = str(tmp_path / "out"), str(tmp_path / "broken")
    open(flag, "w").close()

    def check(document):
        if os.path.exists(flag) and document.column("doc_id")[0].as_py() == 4:
            os._exit(1)  # the worker dies in the middle of its documents
        return []

    with pytest.raises(Exception):  # noqa: B017
        gate.publish(staged, path, run_id="a", check=check)
    assert gate.read(spark, path).count() == 0
    os.remove(flag)
    gate.publish(staged, path, run_id="a", check=check)
    assert ids(gate.read(spark, path)) == [(d, p) for d in range(1, 6) for p in (1, 2)]


def test_two_runs_that_commit_at_once_get_two_numbers(tmp_path):
    path = str(tmp_path / "out")
    for run_id in "abca":
        gate._append(path, {"run_id": run_id, "replaces": False, "data": [], "held": []})
    fs, root = gate.file_system(path)
    assert [x["run_id"] for x in gate._log(fs, root)] == ["a", "b", "c"]
    assert not gate.create(fs, f"{root}/log/0000000002.json", b"{}")
    assert [x["run_id"] for x in gate._log(fs, root)] == ["a", "b", "c"]


def test_a_run_is_published_through_the_gate(spark, tmp_path):
    """Redacted words no longer leak under a rectangle, others do."""
    docs = spark.createDataFrame([(1, "mail a@bc.de now"), (2, "plain words here"), (3, "more")], "k long, t string")
    box = F.struct(F.lit(1).cast("long").alias("rect_id"), F.lit(30.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(78.0).alias("x1"), F.lit(9.5).alias("y1"), F.array(F.lit(0.0)).alias("fill"))
    pages = corpus.paginate(docs, "k", F.col("t")).withColumn("rects", F.array(box))
    metadata = spark.createDataFrame([(1, "author", "Ann"), (2, "author", "Bob")], "doc_id long, field string, value string")
    result = plan.run(pages, rulepacks.load("pii"), metadata=metadata)
    assert {r["doc_id"]: r["passed"] for r in result.report.collect()} == {1: True, 2: False, 3: True}
    assert [(r["doc_id"], r["value"]) for r in result.metadata.collect()] == [(1, "")]
    path = str(tmp_path / "out")
    gate.publish(result.staged, path)
    got = {r["doc_id"]: [w["text"] for w in r["words"]] for r in gate.read(spark, path).collect()}
    assert got == {1: ["mail", "now"], 3: ["more"]} == {r["doc_id"]: [w["text"] for w in r["words"]] for r in result.pages.collect()}
    assert gate.read(spark, path, "held").first()["leaks"][0]["page"] == 1
