"""Redaction of pages, differences between versions, and checks for what is left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, contains_sorted, covered_by, merged, rank
from ..sources.corpus import WORDS_TYPE, page_text
from .covers import texts_under

# A fill is dark if its first three components are under DARK; a thinner box hides no text; tolerance in points.
DARK, MIN_HEIGHT, TOLERANCE = 0.5, 5.0, 1.0
METADATA_FIELDS = ("author", "title", "subject", "keywords", "creator", "producer")
XMP_CHARS = 200


FOUND = "array<struct<word_start:int,word_end:int,kind:string,confidence:string,source:string,seq:bigint>>"


def with_ranges(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Pages with a column found, the ranges of the findings on them: the findings are gathered by page and joined once, pages are never exploded."""
    ranges = findings.groupBy("doc_id", "page").agg(F.collect_set(F.struct("word_start", "word_end")).alias("found"))
    return pages.join(ranges, ["doc_id", "page"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<word_start:int,word_end:int>>")))


def with_found(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Pages with a column found, the findings on them as a table has them, in the order of seq."""
    row = F.struct("seq", "word_start", "word_end", "kind", "confidence", "source")
    by_page = findings.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row)).alias("f"))
    order = lambda f: F.struct(*[f[c].alias(c) for c in ("word_start", "word_end", "kind", "confidence", "source", "seq")])
    joined = pages.select("doc_id", "page", "words").join(by_page, ["doc_id", "page"], "left")
    return joined.select("doc_id", "page", "words", F.coalesce(F.transform("f", order).cast(FOUND), F.array().cast(FOUND)).alias("found"))


#: Ranges or rectangles of a page up to which each word is simply tested against all of them.
FEW = 16


def _by_hits(body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """body of a test whether a word is covered by a range of the row's column found.

    Many ranges are merged once for the row, and each word is looked up in them by its index.
    """
    one_by_one = body(lambda w: F.exists("found", lambda r: w["idx"].between(r["word_start"], r["word_end"])))
    looked_up = bind(merged(F.col("found"), "word_start", "word_end"), lambda m: body(lambda w: covered_by(m, w["idx"])))
    return F.when(F.size("found") <= FEW, one_by_one).otherwise(looked_up)


def left_over() -> Column:
    """The words of the row's page that no range of its column found covers."""
    return F.when(F.size("found") == 0, F.col("words")).otherwise(_by_hits(lambda hit: F.filter("words", lambda w: ~hit(w))))


def redact_found(pages: DataFrame) -> DataFrame:
    """Pages (with a column found) without the words that any range covers; the words that stay keep their index and box."""
    return pages.select("doc_id", "page", left_over().alias("words"))


def redact(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """The same for findings in a table of their own."""
    return redact_found(with_ranges(pages, findings))


def text_found(pages: DataFrame, token: str = "█") -> DataFrame:
    """(doc_id, page, text) of pages with a column found: the words with a token in the place of each covered one."""
    masked = _by_hits(lambda hit: F.array_join(F.transform("words", lambda w: F.when(hit(w), F.lit(token)).otherwise(w["text"])), " "))
    return pages.select("doc_id", "page", F.when(F.size("found") == 0, page_text(F.col("words"))).otherwise(masked).alias("text"))


def redacted_text(pages: DataFrame, findings: DataFrame, token: str = "█") -> DataFrame:
    """The same for findings in a table of their own."""
    return text_found(with_ranges(pages, findings), token)


def _key(w: Column) -> Column:
    """Place and text of a word, the place in tenths of a point, half to even; whole numbers, the usual case, are not rounded."""
    tenths = lambda v: F.when(F.rint(v) == v, v * 10).otherwise(F.rint(F.bround(v, 1) * 10)).cast("long").cast("string")
    at = lambda v: F.when(F.abs(v) < 1e15, tenths(v)).otherwise(F.bround(v, 1).cast("string"))
    return F.concat_ws(" ", at(w["x0"]), at(w["y0"]), w["text"])


def _gone(versions: DataFrame) -> Column:
    """The words of the row's column words that its column after lacks at their place, each as often as it is there.

    Places and texts are keys, of which both versions are maps that Spark zips by hashes. Where a key is there twice,
    the later version's are sorted once for the row and looked up.
    """
    later = F.array_distinct(F.transform("after", _key))

    def zipped(mine: Column) -> Column:
        left = F.map_zip_with(F.map_from_arrays(mine, F.col("words")), bind(later, lambda keys: F.map_from_arrays(keys, keys)), lambda k, w, there: F.when(there.isNull(), w))
        return F.filter(F.map_values(left), lambda w: w.isNotNull())

    def searched() -> Column:
        keyed = F.transform("words", lambda w: F.struct(_key(w).alias("k"), w.alias("w")))
        return bind(F.sort_array(later), lambda keys: F.transform(F.filter(keyed, lambda s: ~contains_sorted(keys, s["k"])), lambda s: s["w"]))

    lost = bind(F.transform("words", _key), lambda mine: F.when(F.size(F.array_distinct(mine)) == F.size(mine), zipped(mine)).otherwise(searched()))
    # Words of one type are compared as they are, up to the first difference.
    one_type = versions.schema["words"].dataType.simpleString() == versions.schema["after"].dataType.simpleString()
    places = lambda c: F.col(c) if one_type else F.transform(c, lambda w: F.struct(w["text"], w["x0"], w["y0"]))
    return F.when(places("words") == places("after"), F.slice("words", 1, 0)).otherwise(lost)


def _versions(original: DataFrame, redacted: DataFrame, how: str, *fields: str) -> DataFrame:
    """Pages with their later version in a column after; one join, of the fields that are asked for and those of a key."""
    slim = F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in dict.fromkeys(["text", "x0", "y0", *fields])]))
    key = F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in ("text", "x0", "y0")]))
    return original.select("doc_id", "page", slim.alias("words")).join(redacted.select("doc_id", "page", key.alias("after")), ["doc_id", "page"], how)


def removed_from(versions: DataFrame) -> DataFrame:
    """removed_words of pages that have their later version in a column after, null where it is missing: nothing is joined or shuffled."""
    rows = versions.select("doc_id", "page", F.inline_outer(F.when(F.col("after").isNull(), F.col("words")).otherwise(_gone(versions)))).where("idx IS NOT NULL")
    return rows.select("doc_id", "page", "idx", "text", "x0", "y0", "x1", "y1")


def removed_words(original: DataFrame, redacted: DataFrame) -> DataFrame:
    """Words of the original pages that the redacted ones lack at their place: (doc_id, page, idx, text, x0, y0, x1, y1). A page that is missing lacks all."""
    return removed_from(_versions(original, redacted, "left", "idx", "x1", "y1"))


def require_same_pages(original: DataFrame, redacted: DataFrame) -> None:
    """Raise ValueError if a document has not as many pages in one version as in the other."""
    count = lambda df, n: df.groupBy("doc_id").agg(F.count("*").alias(n))
    both = count(original, "a").join(count(redacted, "b"), "doc_id", "full")
    if bad := both.where("NOT a <=> b").first():
        raise ValueError(f"page count differs in document {bad['doc_id']}: {bad['a']} and {bad['b']}")


def diff_of(versions: DataFrame) -> DataFrame:
    """page_diff of pages that have their later version in a column after: the difference is taken inside the row, nothing is joined or shuffled."""
    removed = F.transform(_gone(versions), lambda w: w["text"])
    return versions.select("doc_id", "page", page_text(F.col("words")).alias("before_text"), page_text(F.col("after")).alias("after_text"), removed.alias("removed"))


def page_diff(original: DataFrame, redacted: DataFrame) -> DataFrame:
    """(doc_id, page, before_text, after_text, removed): pages with the words removed from them, in order; pages without any stay.

    Both versions of a page are joined once.
    """
    return diff_of(_versions(original, redacted, "inner"))


def diff_found(pages: DataFrame) -> DataFrame:
    """The same for pages with a column found and their own redaction: what goes is in the row, so that nothing is joined."""
    none = F.array().cast("array<string>")
    removed = F.when(F.size("found") > 0, _by_hits(lambda hit: F.transform(F.filter("words", hit), lambda w: w["text"]))).otherwise(none)
    return pages.select("doc_id", "page", page_text(F.col("words")).alias("before_text"), page_text(left_over()).alias("after_text"), removed.alias("removed"))


def render_json(diff: DataFrame) -> DataFrame:
    """(doc_id, page, line): each page of a diff as one compact line of JSON."""
    return diff.select("doc_id", "page", F.to_json(F.struct("page", "removed", "before_text", "after_text")).alias("line"))


def render_text(diff: DataFrame) -> DataFrame:
    """(doc_id, page, line): what was removed from each page, in words."""
    line = F.format_string("page %d: %d removed%s", "page", F.size("removed"), F.when(F.size("removed") > 0, F.concat(F.lit(": "), F.array_join("removed", ", "))).otherwise(""))
    return diff.select("doc_id", "page", line.alias("line"))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def render_html(diff: DataFrame) -> DataFrame:
    """(doc_id, html): a table of the pages of each document, texts escaped."""
    row = F.format_string("<tr><td>%d</td><td>%s</td><td>%s</td><td>%s</td></tr>", "page", escape_html(F.array_join("removed", ", ")), escape_html(F.col("before_text")), escape_html(F.col("after_text")))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", row.alias("row")))), lambda x: x["row"]), "\n")
    return diff.groupBy("doc_id").agg(F.concat(F.lit("<table>\n"), rows, F.lit("\n</table>")).alias("html"))


# ---- verification ----


def is_dark(fill: Column) -> Column:
    """True if a fill has components and the first three are all dark."""
    return F.coalesce((F.size(fill) > 0) & F.forall(F.slice(fill, 1, 3), lambda c: c < DARK), F.lit(False))


def overlays(rects: DataFrame) -> DataFrame:
    """The rectangles (doc_id, page, rect_id, x0, y0, x1, y1, fill) that could hide text: dark and high enough."""
    return rects.where(is_dark(F.col("fill")) & (F.col("y1") - F.col("y0") >= MIN_HEIGHT))


RECTS = "array<struct<rect_id:bigint,x0:double,y0:double,x1:double,y1:double,fill:array<double>>>"


def with_rects(pages: DataFrame, rects: DataFrame) -> DataFrame:
    """Pages with a column rects, the overlays among the rectangles of a table on them; one join."""
    box = F.struct("rect_id", "x0", "y0", "x1", "y1", "fill")
    by_page = overlays(rects).groupBy("doc_id", "page").agg(F.collect_list(box).cast(RECTS).alias("rects"))
    return pages.join(by_page, ["doc_id", "page"], "left").withColumn("rects", F.coalesce("rects", F.array().cast(RECTS)))


def covered_texts(words: Column | str = "words") -> Column:
    """array<struct<rect_id, recovered_text>>: the text under each dark rectangle of the row's column rects, where there is more than punctuation.

    With many rectangles the words are sorted by their left and by their upper edges once for the
    row; a rectangle looks up the words that begin within its width and those within its height, and
    tests the fewer. Boxes are well formed: left before right, upper before lower.
    """
    words = F.col(words) if isinstance(words, str) else words
    r_in = lambda w, r: (
        (w["x0"] >= r["x0"] - TOLERANCE) & (w["y0"] >= r["y0"] - TOLERANCE) & (w["x1"] <= r["x1"] + TOLERANCE) & (w["y1"] <= r["y1"] + TOLERANCE)
    )
    dark = F.filter("rects", lambda r: is_dark(r["fill"]) & (r["y1"] - r["y0"] >= MIN_HEIGHT))
    row = lambda r, text: F.struct(r["rect_id"].alias("rect_id"), text.alias("recovered_text"))
    joined = lambda ws: F.array_join(F.transform(ws, lambda w: w["text"]), " ")

    def one_by_one(ws: Column) -> Column:
        return F.transform(dark, lambda r: row(r, joined(F.filter(ws, lambda w: r_in(w, r)))))

    def edges(ws: Column, first: str) -> Column:
        """The words in the order of an edge: struct<at, w>."""
        sort = F.sort_array(F.transform(ws, lambda w: F.struct(w[first].alias("k"), *[w[c].alias(c) for c in ("idx", "text", "x0", "y0", "x1", "y1")])))
        return bind(sort, lambda s: F.struct(F.transform(s, lambda w: w["k"]).alias("at"), s.alias("w")))

    def within(e: Column, low: Column, high: Column) -> Column:
        a, b = rank(e["at"], low - TOLERANCE), rank(e["at"], high + TOLERANCE, lambda v, x: v <= x)
        return F.struct(a.alias("a"), F.greatest(b - a, F.lit(0)).alias("n"))

    def looked_up(x: Column, y: Column) -> Column:
        def text(r: Column, wide: Column, tall: Column) -> Column:
            few = F.when(wide["n"] <= tall["n"], F.slice(x["w"], wide["a"] + 1, wide["n"])).otherwise(F.slice(y["w"], tall["a"] + 1, tall["n"]))
            inside = F.filter(few, lambda w: r_in(w, r))
            return joined(F.sort_array(F.transform(inside, lambda w: F.struct(w["idx"].alias("idx"), w["text"].alias("text")))))

        return F.transform(dark, lambda r: row(r, bind(within(x, r["x0"], r["x1"]), lambda wide: bind(within(y, r["y0"], r["y1"]), lambda tall: text(r, wide, tall)))))

    many = bind(words, lambda ws: bind(edges(ws, "x0"), lambda x: bind(edges(ws, "y0"), lambda y: looked_up(x, y))))
    found = F.when(F.size("rects") <= FEW, bind(words, one_by_one)).otherwise(many)
    return _readable(found)


def _readable(found: Column) -> Column:
    """The recovered texts in which there is more than punctuation."""
    return F.filter(found, lambda t: t["recovered_text"].rlike(r"[\p{L}\p{N}]"))


OVERLAY, OVERLAY_DETAIL = "text_under_overlay", "text can be read under a dark rectangle"
LEAKS = "array<struct<page:int,kind:string,detail:string>>"


def seen_leaks(pages: DataFrame) -> DataFrame:
    """Pages with a column seen (covered_texts) as leaks: (doc_id, page, rect_id, kind, recovered_text, detail), one row a rectangle."""
    rows = pages.select("doc_id", "page", F.inline_outer("seen")).where("rect_id IS NOT NULL")
    return rows.select("doc_id", "page", "rect_id", F.lit(OVERLAY).alias("kind"), "recovered_text", F.lit(OVERLAY_DETAIL).alias("detail"))


def found_leaks(pages: DataFrame) -> DataFrame:
    """Text under dark rectangles of pages with a column rects.

    Pages with few rectangles are tested by Spark; those with more go to the tasks' Python in Arrow batches, as
    Spark interprets a search for each rectangle (covered_texts), which takes many times as long.
    """
    few = F.size("rects") <= FEW

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            many = texts_under(f.column("words"), f.column("rects"), dark=DARK, min_height=MIN_HEIGHT, tolerance=TOLERANCE)
            yield pa.RecordBatch.from_arrays([*(f.column(c) for c in ("doc_id", "page", "few")), many], ["doc_id", "page", "few", "many"])

    kind = "array<struct<rect_id:bigint,recovered_text:string>>"
    split = pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), F.when(few, covered_texts()).cast(kind).alias("few"), F.when(~few, F.col("words")).cast(WORDS_TYPE).alias("words"), F.when(~few, F.col("rects")).cast(RECTS).alias("rects"))
    seen = split.mapInArrow(run, f"doc_id long, page int, few {kind}, many {kind}")
    return seen_leaks(seen.select("doc_id", "page", F.coalesce("few", _readable(F.col("many"))).alias("seen")))


def overlay_leaks(pages: DataFrame, rects: DataFrame) -> DataFrame:
    """Text under dark rectangles of a table (doc_id, page, rect_id, x0, y0, x1, y1, fill).

    The rectangles of a page are gathered and joined with the page, which holds its words in an
    array, so that the test runs inside a row. A rectangle over punctuation only is no leak.
    """
    return found_leaks(with_rects(pages, rects))


def metadata_leaks(metadata: DataFrame) -> DataFrame:
    """Non-empty metadata (doc_id, field, value); the field "xmp" is the metadata stream. Same columns as overlay_leaks, page 0."""
    value = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    std = metadata.where(F.col("field").isin(*METADATA_FIELDS) & (value != ""))
    detail = F.concat(F.lit("metadata field "), "field", F.lit(" holds '"), value, F.lit("'"))
    plain = std.select("doc_id", F.lit(0).alias("page"), F.lit(None).cast("long").alias("rect_id"), F.lit("metadata").alias("kind"), value.alias("recovered_text"), detail.alias("detail"))
    xmp = metadata.where((F.col("field") == "xmp") & (value != ""))
    return plain.union(xmp.select("doc_id", F.lit(0), F.lit(None).cast("long"), F.lit("metadata"), F.substring(value, 1, XMP_CHARS), F.lit("the metadata stream is not empty")))


def clear_metadata(metadata: DataFrame) -> DataFrame:
    """The metadata (doc_id, field, value) that a redacted document is written with: all fields, the metadata stream included, are empty."""
    return metadata.withColumn("value", F.lit(""))


def leak_counts(pages: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_overlays, n_metadata) of every document of pages with a column rects: one pass over the pages, one over the metadata."""
    per = pages.groupBy("doc_id").agg(F.sum(F.size(covered_texts())).alias("n_overlays"))
    if metadata is None:
        return per.withColumn("n_metadata", F.lit(0).cast("long"))
    more = metadata_leaks(metadata).groupBy("doc_id").agg(F.count("*").alias("n_metadata"))
    return per.join(more, "doc_id", "left").select("doc_id", "n_overlays", F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def report_of(counts: DataFrame) -> DataFrame:
    """(doc_id, passed, n_leaks, summary) of documents with the columns n_overlays and n_metadata; the summary counts leaks by kind, text under overlays first."""
    part = lambda c, kind: F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c).cast("string"), F.lit(kind)))
    n, parts = F.col("n_overlays") + F.col("n_metadata"), F.concat_ws(", ", part("n_overlays", "text_under_overlay"), part("n_metadata", "metadata"))
    return counts.select("doc_id", (n == 0).alias("passed"), n.alias("n_leaks"), F.when(n == 0, "nothing left").otherwise(parts).alias("summary"))


def reports(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """(doc_id, passed, n_leaks, summary) of every document; the summary counts leaks by kind, text under overlays first."""
    kinds = leaks.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    order = F.struct(F.when(F.col("kind") == "text_under_overlay", 0).otherwise(1).alias("o"), F.concat_ws(" ", F.col("n").cast("string"), "kind").alias("s"))
    per = kinds.groupBy("doc_id").agg(F.sum("n").alias("n_leaks"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["s"]), ", ").alias("summary"))
    joined = documents.select("doc_id").distinct().join(per, "doc_id", "left")
    return joined.select("doc_id", F.col("n_leaks").isNull().alias("passed"), F.coalesce("n_leaks", F.lit(0)).alias("n_leaks"), F.coalesce("summary", F.lit("nothing left")).alias("summary"))
