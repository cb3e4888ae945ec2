"""Page selections: "1,3-5" and the pages that it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_ranges


class SelectionError(ValueError):
    pass


def parse(spec: str) -> list[int]:
    """Pages that a selection names, sorted and once each; SelectionError for anything but numbers from 1 and ranges."""
    if not spec.strip():
        raise SelectionError("the page selection is empty")
    pages: set[int] = set()
    for part in (p.strip() for p in spec.split(",")):
        ends = [e.strip() for e in part.split("-", 1)]
        if not all(ends):
            raise SelectionError(f"an empty part, or a range without two ends, in {spec!r}")
        try:
            numbers = [int(e) for e in ends]
        except ValueError:
            raise SelectionError(f"no page number: {part!r}") from None
        if numbers[0] < 1 or numbers[-1] < numbers[0]:
            raise SelectionError(f"pages begin with 1 and ranges go upwards: {part!r}")
        pages.update(range(numbers[0], numbers[-1] + 1))
    return sorted(pages)


def expand(spec: Column) -> Column:
    """The same for a column of valid selections, as a sorted array<int>."""
    ends = lambda p: F.transform(F.split(p, "-"), lambda e: F.trim(e).cast("int"))
    pages = F.transform(F.split(spec, ","), lambda p: F.sequence(F.get(ends(p), F.lit(0)), F.element_at(ends(p), -1)))
    return F.array_sort(F.array_distinct(F.flatten(pages)))


def select_pages(pages: DataFrame, spec: str) -> DataFrame:
    """The selected pages, with their own numbers and indexes. The filter stands right on the pages, so that it reaches the scan where there is one."""
    return pages.where(F.col("page").isin(parse(spec)))


def out_of_range(selections: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, bad_pages) of documents (doc_id, total_pages) that lack pages of their selection (doc_id, spec)."""
    bad = F.filter(expand(F.col("spec")), lambda p: p > F.col("total_pages"))
    joined = selections.join(documents, "doc_id").select("doc_id", bad.alias("bad"))
    return joined.where(F.size("bad") > 0).select("doc_id", page_ranges(F.col("bad")).alias("bad_pages"))


def require_in_range(selections: DataFrame, documents: DataFrame) -> None:
    """Raise SelectionError for a document that lacks pages of its selection."""
    if bad := out_of_range(selections, documents).first():
        raise SelectionError(f"pages {bad['bad_pages']} are not in document {bad['doc_id']}")


def slice_words(words: Column, start: Column, end: Column) -> Column:
    """Words of a half-open range, numbered from 0 anew; boxes and blocks stay."""
    fresh = lambda w, i: w.withField("idx", i.cast("int"))
    return F.transform(F.slice(words, start + 1, end - start), fresh)
