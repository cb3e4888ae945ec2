"""Undo: findings of an audit log, which of them to take back, and what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.audit import line
from .findings import covered, text_of


def applied(events: DataFrame) -> DataFrame:
    """The applied findings of each session with their ordinal from 0: (session_key, ordinal, page, word_start, word_end, kind, confidence, source, text_sha256, context_sha256)."""
    rows = events.where("event = 'finding' AND decision = 'applied'")
    nth = F.row_number().over(Window.partitionBy("session_key").orderBy("line_no")) - 1
    return rows.select("session_key", nth.alias("ordinal"), "page", "word_start", "word_end", "kind", "confidence", "source", "text_sha256", "context_sha256")


def parse_words(spec: str | None) -> tuple[int, int] | None:
    """The first and last word that a text START-END names; ValueError for any other text."""
    if spec is None:
        return None
    left, _, right = spec.partition("-")
    try:
        return int(left), int(right)
    except ValueError:
        raise ValueError(f"words are START-END, not {spec!r}") from None


def exclusions(found: DataFrame, *, pages: list[int] | None = None, page: int | None = None, kind: str | None = None, words: tuple[int, int] | None = None, picked: DataFrame | None = None) -> DataFrame:
    """(session_key, ordinal) of the findings to take back: those that pass all given filters, and the picked ones. Without any none."""
    tests = []
    if pages is not None:
        tests.append(F.col("page").isin(pages))
    if page is not None:
        tests.append(F.col("page") == page)
    if kind is not None:
        tests.append(F.col("kind") == kind)
    if words is not None:
        tests.append((F.col("word_start") == words[0]) & (F.col("word_end") == words[1]))
    out = found.select("session_key", "ordinal").limit(0)
    if tests:
        both = tests[0]
        for t in tests[1:]:
            both &= t
        out = found.where(both).select("session_key", "ordinal")
    return out if picked is None else out.union(picked.select("session_key", "ordinal")).distinct()


#: What a selector may ask for; the two ends of a range of words go together.
ASKED = (("session_key",), ("page",), ("kind",), ("word_start", "word_end"))


def exclusions_of(found: DataFrame, selectors: DataFrame) -> DataFrame:
    """(session_key, ordinal) of the findings of many sessions that any selector (session_key, page, kind, word_start, word_end) picks; null means any.

    Selectors that ask for the same columns are joined on these: each of the sixteen shapes is an
    equi-join, and only those that occur are made. One that asks for nothing picks all.
    """
    has = [F.col(c[0]).isNotNull() & F.col(c[-1]).isNotNull() for c in ASKED]
    shape = sum((F.when(h, 1 << i).otherwise(0) for i, h in enumerate(has)), F.lit(0))
    shaped = selectors.withColumn("shape", shape)
    out = found.select("session_key", "ordinal").limit(0)
    for r in shaped.select("shape").distinct().collect():  # sixteen at most
        columns = [c for i, group in enumerate(ASKED) if r["shape"] >> i & 1 for c in group]
        wanted = shaped.where(F.col("shape") == r["shape"])
        picked = found.join(wanted.select(*columns).distinct(), columns, "left_semi") if columns else found
        out = out.unionByName(picked.select("session_key", "ordinal"))
    return out.distinct()


def kept(found: DataFrame, excluded: DataFrame) -> DataFrame:
    return found.join(excluded, ["session_key", "ordinal"], "left_anti")


def page_choices(found: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """(session_key, page, n_findings) that a user picks pages from; of the listed pages only, if there is a list."""
    some = found if pages is None else found.where(F.col("page").isin(pages))
    return some.groupBy("session_key", "page").agg(F.count("*").alias("n_findings"))


def expand_pages(found: DataFrame, picked_pages: DataFrame) -> DataFrame:
    """All findings on the picked pages (session_key, page)."""
    return found.join(picked_pages, ["session_key", "page"], "left_semi").select("session_key", "ordinal")


def texts(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(session_key, ordinal, text): the words that each finding covers in the original pages (doc_id is the session_key as a number), empty where the page is missing."""
    words = pages.select(F.col("doc_id").cast("string").alias("session_key"), "page", "words")
    text = F.when(F.col("words").isNull(), "").otherwise(text_of(covered()))
    return found.join(words, ["session_key", "page"], "left").select("session_key", "ordinal", text.alias("text"))


def undo_events(found: DataFrame, excluded: DataFrame, ts: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(session_key, ordinal, value): an undo event for each finding that is taken back, as a line of JSON; hashes that the log lacks are empty."""
    rows = found.join(excluded, ["session_key", "ordinal"], "left_semi")
    hashes = [F.coalesce(c, F.lit("")).alias(c) for c in ("text_sha256", "context_sha256")]
    return rows.select("session_key", "ordinal", line(F.lit("undo_finding").alias("event"), F.lit(ts).alias("ts"), "page", "word_start", "word_end", "kind", "source", *hashes).alias("value"))
