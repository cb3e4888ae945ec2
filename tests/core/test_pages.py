"""Conditions on pages reach the extraction."""

import pytest
from pyspark.sql import functions as F

from shroudline.operators import rules, selection
from shroudline.sources import files, pages, rulepacks


@pytest.fixture
def corpus(tmp_path):
    """Six files of five pages; file k's page p holds the words k and p."""
    folder = tmp_path / "in"
    (folder / "more").mkdir(parents=True)
    for k in range(6):
        (folder / ("more" if k > 3 else "") / f"f{k}.txt").write_text("\f".join(f"file{k} page{p} a{k}@bc.de" for p in range(1, 6)))
    (folder / "_hidden.txt").write_text("x")
    (folder / "other.md").write_text("y")
    return str(folder)


@pytest.fixture
def counting(tmp_path):
    """An extractor that notes each page it parses."""
    log = str(tmp_path / "parsed")

    def extract(content, wanted):
        out = []
        for n, text in enumerate(content.decode().split("\f"), 1):
            if wanted is None or n in wanted:
                with open(log, "a") as note:
                    note.write(f"{text.split()[0]}:{n}\n")
                out += files.plain_text(b"\f" * (n - 1) + text.encode(), [n])
        return out

    return extract, lambda: sorted(open(log).read().split())


def parsed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unselected_pages_are_never_parsed(spark, corpus, counting):
    extract, seen = counting
    df = selection.select_pages(pages.read_pages(spark, corpus, extract, glob="*.txt").where(F.col("path").contains("/more/")), "2,4-5")
    assert "Filter (" not in parsed(df)
    assert sorted((r["path"][-6:-4], r["page"]) for r in df.collect()) == [(f"f{k}", p) for k in (4, 5) for p in (2, 4, 5)]
    assert seen() == [f"file{k}:{p}" for k in (4, 5) for p in (2, 4, 5)]


def test_what_can_be_pushed_is_and_the_rest_is_filtered(spark, corpus, counting):
    extract, seen = counting
    df = pages.read_pages(spark, corpus, extract, glob="*.txt")
    for condition, want, pushed in (
        (F.col("page") == 3, {3}, True), ((F.col("page") > 1) & (F.col("page") <= 3), {2, 3}, True), (F.col("page") != 2, {1, 3, 4, 5}, True), (F.col("page").isin(1, 9), {1}, True),
        (F.col("page") % 2 == 0, {2, 4}, False), ((F.col("page") == 1) | (F.col("page") == 5), {1, 5}, None), (F.size("words") > 99, set(), False),
    ):
        got = df.where(condition)
        assert {r["page"] for r in got.collect()} == want
        if pushed is not None:
            assert ("Filter (" not in parsed(got)) == pushed
    assert df.count() == 30


def test_files_are_packed_into_ranges(spark, corpus, counting):
    extract, _ = counting
    one = len(b"\f".join(b"file0 page1 a0@bc.de" for _ in range(5)))
    assert pages.read_pages(spark, corpus, extract, glob="*.txt").rdd.getNumPartitions() == 1
    assert pages.read_pages(spark, corpus, extract, glob="*.txt", range_bytes=2 * one).rdd.getNumPartitions() == 3
    assert pages.read_pages(spark, corpus, extract, glob="*.txt", range_bytes=1).rdd.getNumPartitions() == 6
    assert pages.read_pages(spark, corpus, extract, glob="*.pdf").count() == 0
    assert pages.read_pages(spark, f"{corpus}/f1.txt", extract).count() == 5


def test_pages_feed_the_rules_and_recognizers(spark, corpus):
    df = pages.read_pages(spark, corpus, files.plain_text, glob="*.txt").select(F.xxhash64("path").alias("doc_id"), "page", "words")
    assert rules.regex_findings(df, rulepacks.load("pii")).count() == 30
    scanned = lambda content, wanted: [(n, [], n == 2) for n in (1, 2, 3) if wanted is None or n in wanted]
    seen = pages.read_pages(spark, corpus, scanned, recognizer=lambda content, images: [(n, ["seen"], True) for n in images], glob="f0.txt")
    assert {r["page"]: [w["text"] for w in r["words"]] for r in seen.collect()} == {1: [], 2: ["seen"], 3: []}
