"""Findings: joins with words, deduplication, parsing of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of context on either side of a finding, and points by which its box grows upwards and downwards. Fixed values.
CONTEXT_WORDS, BOX_PADDING = 16, 1.5

RANKS = {"high": 3, "medium": 2, "low": 1}


def rank(confidence: Column) -> Column:
    """3, 2, 1 for high, medium, low; 0 for anything else."""
    out = F.when(confidence == "high", 3)
    for name in ("medium", "low"):
        out = out.when(confidence == name, RANKS[name])
    return out.otherwise(0)


def with_words(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings with the words of their page; findings on unknown pages go. One equi-join; ranges are then slices."""
    return findings.join(pages.select("doc_id", "page", "words"), ["doc_id", "page"])


def covered(start: Column | str = "word_start", end: Column | str = "word_end", words: Column | str = "words") -> Column:
    """The words of an inclusive range, the row's own if no other is given; none if it begins behind the page."""
    start, end, words = (F.col(c) if isinstance(c, str) else c for c in (start, end, words))
    return F.slice(words, start + 1, F.greatest(end - start + 1, F.lit(0)))


def text_of(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def context(start: Column | str = "word_start", end: Column | str = "word_end", words: Column | str = "words") -> Column:
    """Text of the range with up to CONTEXT_WORDS words on either side."""
    start, end, words = (F.col(c) if isinstance(c, str) else c for c in (start, end, words))
    lo = F.greatest(start - CONTEXT_WORDS, F.lit(0))
    return text_of(F.slice(words, lo + 1, F.least(F.size(words), end + CONTEXT_WORDS + 1) - lo))


def box_union(words: Column) -> Column:
    """struct<x0, y0, x1, y1> around words; null for none."""
    side = lambda f, name: f(F.transform(words, lambda w: w[name])).alias(name)
    return F.when(F.size(words) > 0, F.struct(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1")))


def padded(box: Column) -> Column:
    return F.when(box.isNotNull(), F.struct(box["x0"].alias("x0"), (box["y0"] - BOX_PADDING).alias("y0"), box["x1"].alias("x1"), (box["y1"] + BOX_PADDING).alias("y1")))


def finding_box() -> Column:
    """The padded box of a finding's words; null if the range isn't on the page."""
    inside = (F.col("word_start") >= 0) & (F.col("word_start") <= F.col("word_end")) & (F.col("word_end") < F.size("words"))
    return F.when(inside, padded(box_union(covered())))


def dedupe(findings: DataFrame, scope: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One finding for each range and kind: the one of highest confidence, of equal ones the first.

    It takes the place (seq) of the first one. Ranges that overlap only, and other kinds, stay.
    """
    key = [*scope, "page", "word_start", "word_end", "kind"]
    best = F.struct(rank(F.col("confidence")).alias("r"), (-F.col("seq")).alias("s"), "confidence", "source")
    return (
        findings.groupBy(*key)
        .agg(F.max(best).alias("b"), F.min("seq").alias("seq"))
        .select(*key, "b.confidence", "b.source", "seq")
    )


def translate(findings: DataFrame) -> DataFrame:
    """Ranges found on a slice of a page (slice_start) moved to the page."""
    shift = F.coalesce("slice_start", F.lit(0))
    return findings.withColumns({"word_start": F.col("word_start") + shift, "word_end": F.col("word_end") + shift})


def _int(c: Column) -> Column:
    """Integers and decimals (cut) written as JSON numbers or texts; "true" and "false" as 1 and 0."""
    text = F.trim(c)
    return (
        F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
        .when(text.rlike(r"^[+-]?\d*\.\d+$"), text.try_cast("double").try_cast("int"))
        .when(text == "true", 1)
        .when(text == "false", 0)
    )


def _typed(answers: DataFrame, source: Column, *keep: str) -> DataFrame:
    """The items of model answers with numbers as numbers, and the answers' columns to keep."""
    item = "struct<page:string,start:string,end:string,kind:string,confidence:string>"
    items = answers.select("doc_id", *keep, F.posexplode(F.from_json("payload", f"findings array<{item}>")["findings"]).alias("seq", "i"))
    known = F.col("i.confidence").isin(*RANKS)
    return items.select(
        "doc_id", *keep, _int(F.col("i.page")).alias("page"), _int(F.col("i.start")).alias("word_start"), _int(F.col("i.end")).alias("word_end"),
        F.col("i.kind").alias("kind"), F.when(known, F.col("i.confidence")).otherwise("medium").alias("confidence"), source.alias("source"), F.col("seq").cast("long").alias("seq"),
    )


def _judged(sized: DataFrame) -> DataFrame:
    """Items whose page has n_words, null where it is unknown, with a flag: ok where they are findings on a known page."""
    whole = F.col("kind").isNotNull() & (F.col("word_start") >= 0) & (F.col("word_start") <= F.col("word_end")) & (F.col("word_end") < F.col("n_words"))
    return sized.withColumn("ok", F.coalesce(whole, F.lit(False))).drop("n_words")


def _items(answers: DataFrame, page_sizes: DataFrame, source: Column) -> DataFrame:
    """The items of model answers with a flag: ok where they are findings on a known page."""
    return _judged(_typed(answers, source).join(page_sizes, ["doc_id", "page"], "left"))


def parse_own_pages(answers: DataFrame, source: Column) -> DataFrame:
    """parse_payloads of answers that carry their pages and, in the same order, how many words these have (sizes): nothing is joined."""
    rows = _typed(answers, source, "pages", "sizes")
    n = F.get("sizes", F.array_position("pages", F.col("page")).cast("int") - 1)
    return _judged(rows.withColumn("n_words", n).drop("pages", "sizes")).where("ok").drop("ok")


def parse_payloads(answers: DataFrame, page_sizes: DataFrame, source: Column) -> DataFrame:
    """Findings of model answers (doc_id, payload JSON {"findings": [...]}); page_sizes (doc_id, page, n_words).

    An item goes if a field is missing or no number, if its page is unknown, or if its range isn't
    on the page; a confidence that isn't known counts as medium. seq follows the order in the answer.
    """
    return _items(answers, page_sizes, source).where("ok").drop("ok")


def dropped_items(answers: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """(doc_id, n_kept, n_dropped): how many items of the answers parse_payloads keeps and drops."""
    items = _items(answers, page_sizes, F.lit(None).cast("string"))
    return items.groupBy("doc_id").agg(F.count_if("ok").alias("n_kept"), F.count_if(~F.col("ok")).alias("n_dropped"))


def best_position(findings: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings with their ordinal among those of their document, from 0, by seq."""
    return findings.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy("seq")) - 1)
