"""Corpora as pages of indexed words.

A pages table is (doc_id long, page int, words array<struct<idx int, text string, block_id int,
x0, y0, x1, y1 double>>). Words stay nested: most operators work on a page in place, without a
join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import table

#: Words of a page of the table adapters.
PAGE_WORDS = 400

WORDS_TYPE = "array<struct<idx:int,text:string,block_id:int,x0:double,y0:double,x1:double,y1:double>>"


#: White space between words; a line feed also ends a block.
_BLANK = " \t\f\r"


def split_words(text: Column) -> Column:
    """array<struct<text, block_id>>: words between ASCII white space; the block is the number of the line.

    The text is split once into words; the lines only count theirs.
    """
    bare = F.btrim(text, F.lit(_BLANK + "\n"))
    words = F.when(F.length(bare) > 0, F.split(bare, rf"[{_BLANK}\n]+")).otherwise(F.array().cast("array<string>"))
    blocks = F.flatten(F.transform(F.split(text, "\n"), lambda line, b: F.array_repeat(b, F.regexp_count(line, F.lit(f"[^{_BLANK}]+")))))
    return F.arrays_zip(words.alias("text"), blocks.alias("block_id"))


def index_words(words: Column) -> Column:
    """Number the words of a page from 0 and give them synthetic boxes: a fixed pitch of 40 points a word, 12 points a line."""
    return F.transform(
        words,
        lambda w, i: F.struct(
            i.cast("int").alias("idx"),
            w["text"].alias("text"),
            w["block_id"].cast("int").alias("block_id"),
            (i * 40).cast("double").alias("x0"),
            (w["block_id"] * 12).cast("double").alias("y0"),
            (i * 40 + F.length(w["text"]) * 5).cast("double").alias("x1"),
            (w["block_id"] * 12 + 9).cast("double").alias("y1"),
        ),
    )


def with_word(df: DataFrame, text: Column) -> DataFrame:
    """The rows whose text has a word."""
    return df.where(text.rlike(r"[^ \t\n\f\r]"))


def paginate(df: DataFrame, id_col: str, text: Column, page_words: int = PAGE_WORDS) -> DataFrame:
    """Pages of page_words words; a text without a word has no page.

    Texts without a word go by a test of the text: a test of the words would be pushed down and
    split every text twice. For the same reason the explode is an outer one, from which Spark
    infers no filter.
    """
    words = with_word(df, text).select(F.col(id_col).cast("long").alias("doc_id"), split_words(text).alias("w"))
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / page_words).cast("int"))
    cut = words.select("doc_id", F.posexplode_outer(F.transform(starts, lambda p: F.slice("w", p * page_words + 1, page_words))).alias("p", "words"))
    return cut.select("doc_id", (F.col("p") + 1).cast("int").alias("page"), index_words(F.col("words")).alias("words"))


def from_documents(spark: SparkSession, sf_dir: str, page_words: int = PAGE_WORDS) -> DataFrame:
    return paginate(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), page_words)


def from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a document, each turn a page."""
    turns = table(spark, sf_dir, "conversations")
    words = with_word(turns, F.col("text")).select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), split_words(F.col("text")).alias("w"))
    return words.select("doc_id", "page", index_words(F.col("w")).alias("words"))


def strip_markup(html: Column) -> Column:
    """Text of a web page: scripts, styles, comments and tags become spaces."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " "), r"<[^>]*>", " ")


def from_web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web page is a document of one page."""
    pages = table(spark, sf_dir, "pages")
    words = pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), split_words(strip_markup(F.col("html"))).alias("w"))
    return words.select("doc_id", "page", index_words(F.col("w")).alias("words")).where(F.size("words") > 0).select("doc_id", "page", "words")


def explode_words(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.explode("words").alias("w")).select("doc_id", "page", "w.*")


def page_text(words: Column) -> Column:
    """The words with one space between."""
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def documents_dim(pages: DataFrame) -> DataFrame:
    """(doc_id, total_pages, total_words)."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.sum(F.size("words")).alias("total_words"))
