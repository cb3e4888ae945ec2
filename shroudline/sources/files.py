"""Pages from files: any format, by a pluggable extractor; pages without text by a pluggable recognizer.

No library for a page format is part of this one. An extractor is a callable (content, pages or
None) that returns a list of (page number, words, has_image); it gets the selected pages (what can be
asked whether a number is in it), so that it need not read others. Words are texts, or (text, block, x0, y0, x1, y1).
"""

from __future__ import annotations

from collections.abc import Callable, Container

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_ranges
from .corpus import WORDS_TYPE

Extractor = Callable[[bytes, Container[int] | None], list[tuple[int, list, bool]]]


class RecognitionRequired(RuntimeError):
    """Pages hold images, and no recognizer was given."""


def plain_text(content: bytes, pages: Container[int] | None) -> list[tuple[int, list, bool]]:
    """The extractor of text files: form feeds part pages, lines are blocks."""
    out = []
    for n, page in enumerate(content.decode("utf-8", "replace").split("\f"), start=1):
        if pages is None or n in pages:
            words = [(w, b) for b, line in enumerate(page.split("\n")) for w in line.split()]
            out.append((n, [(w, b, i * 40.0, b * 12.0, i * 40.0 + len(w) * 5, b * 12.0 + 9) for i, (w, b) in enumerate(words)], False))
    return out


def pages_of(content: bytes, extractor: Extractor, wanted: Container[int] | None, recognizer: Extractor | None) -> list[tuple[int, list[dict], bool]]:
    """The pages of one file, with the words of a recognizer on those that hold an image."""
    pages = extractor(content, wanted)
    images = [n for n, _, image in pages if image]
    if recognizer is not None and images:
        seen = {n: words for n, words, _ in recognizer(content, images)}
        pages = [(n, seen.get(n, words), image) for n, words, image in pages]
    out = []
    for n, words, image in pages:
        full = [w if isinstance(w, tuple) else (w, 0, 0.0, 0.0, 0.0, 0.0) for w in words]
        out.append((n, [{"idx": i, "text": t, "block_id": b, "x0": x0, "y0": y0, "x1": x1, "y1": y1} for i, (t, b, x0, y0, x1, y1) in enumerate(full)], image))
    return out


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(doc_id, path, content) of the files under path; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def extract(files: DataFrame, extractor: Extractor, selection: list[int] | None = None, recognizer: Extractor | None = None) -> DataFrame:
    """(doc_id, page, words, has_image) of files (doc_id, content). A recognizer replaces the words of the pages that hold an image.

    The selection goes into the extractor, as no filter passes through a Python stage.
    """

    def run(parts):
        for part in parts:
            rows = []
            for doc_id, content in zip(part["doc_id"], part["content"]):
                rows += [(doc_id, *page) for page in pages_of(bytes(content), extractor, selection, recognizer)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "words", "has_image"])

    return files.select("doc_id", "content").mapInPandas(run, f"doc_id long, page int, words {WORDS_TYPE}, has_image boolean")


def require_recognized(extracted: DataFrame, recognizer: Extractor | None) -> DataFrame:
    """Raise RecognitionRequired if pages hold images and there is no recognizer; the message names the pages of one document."""
    if recognizer is None:
        bad = extracted.where("has_image").groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
        if row := bad.select("doc_id", page_ranges(F.col("pages")).alias("pages")).first():
            raise RecognitionRequired(f"pages {row['pages']} of document {row['doc_id']} hold images; text recognition is needed")
    return extracted
