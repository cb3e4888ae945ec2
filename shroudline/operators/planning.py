"""Plan of the calls to a model: batches of pages, submissions, and halves of what is too large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import ensure_checkpoint_dir

#: Words that the halves of a page share at their cut. Fixed value.
OVERLAP = 50


def batches(pages: DataFrame, size: int, *keep: str) -> DataFrame:
    """(doc_id, page, batch_idx) and the columns to keep: consecutive groups of size of a document's pages, in page order."""
    if size < 1:
        raise ValueError(f"a batch has one page at least, not {size}")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.select("doc_id", "page", F.floor((nth - 1) / size).cast("int").alias("batch_idx"), *keep)


def submissions(categories: DataFrame, instructions: DataFrame, default_model: str, active: list[str] | None = None) -> DataFrame:
    """(ord, model, category_ids, instructions): one for each model that has categories, then one for each instruction on the default model.

    categories: (ord, id, detection, model); instructions: (ord, text). Models come in the order of
    their first category. Only active categories count, all if there is no list.
    """
    wanted = categories.where("detection = 'llm'").withColumn("model", F.coalesce("model", F.lit(default_model)))
    if active is not None:
        wanted = wanted.where(F.col("id").isin(active))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"])
    grouped = wanted.groupBy("model").agg(F.min("ord").alias("first"), ids.alias("category_ids"))
    none = F.array().cast("array<string>")
    per_model = grouped.select(F.lit(0).alias("part"), F.col("first").alias("at"), "model", "category_ids", none.alias("instructions"))
    per_rule = instructions.select(F.lit(1).alias("part"), F.col("ord").alias("at"), F.lit(default_model).alias("model"), none.alias("category_ids"), F.array("text").alias("instructions"))
    # As many rows as the rule pack has models and the user has instructions.
    order = F.row_number().over(Window.orderBy("part", "at")) - 1
    return per_model.union(per_rule).select(order.alias("ord"), "model", "category_ids", "instructions")


def joint_submissions(categories: DataFrame, instructions: DataFrame, default_model: str) -> DataFrame:
    """The older plan, with the columns of submissions: the categories of the first model ride with each instruction, on the default model.

    Without instructions they make one submission, without either there is none.
    """
    wanted = categories.where("detection = 'llm'").withColumn("model", F.coalesce("model", F.lit(default_model)))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"])
    first = wanted.groupBy("model").agg(F.min("ord").alias("first"), ids.alias("category_ids")).orderBy("first").limit(1)
    none = F.array().cast("array<string>")
    # At most one row on the left, as many on the right as the user has instructions.
    both = instructions.select("ord", F.array("text").alias("instructions"), F.lit(1).alias("k")).join(F.broadcast(first.select("category_ids", F.lit(1).alias("k"))), "k", "full")
    rows = both.where("instructions IS NOT NULL OR category_ids IS NOT NULL").select(
        F.coalesce("ord", F.lit(0)).alias("at"), F.lit(default_model).alias("model"), F.coalesce("category_ids", none).alias("category_ids"), F.coalesce("instructions", none).alias("instructions")
    )
    return rows.select((F.row_number().over(Window.orderBy("at")) - 1).alias("ord"), "model", "category_ids", "instructions")


def halves(items: DataFrame) -> DataFrame:
    """The two children of each work item (doc_id, path, pages array<int>, w0, w1); items at the floor have none.

    Items of several pages are halved by pages. One page is halved by words: both halves have half
    of the words and OVERLAP more, so that a page of 2 * OVERLAP words or fewer can't be halved.
    path grows by L or R, so that the order of paths is the order of the text.
    """
    n, k = F.col("w1") - F.col("w0"), F.size("pages")
    many = k >= 2
    half = F.floor(n / 2) + OVERLAP
    child = lambda side, pages, a, b: F.struct(F.concat("path", F.lit(side)).alias("path"), pages.alias("pages"), a.cast("int").alias("w0"), b.cast("int").alias("w1"))
    null = F.lit(None)
    left = F.when(many, child("L", F.slice("pages", 1, F.floor(k / 2).cast("int")), null, null)).otherwise(child("L", F.col("pages"), F.col("w0"), F.col("w0") + half))
    right = F.when(many, child("R", F.slice("pages", F.floor(k / 2).cast("int") + 1, k), null, null)).otherwise(child("R", F.col("pages"), F.col("w1") - half, F.col("w1")))
    splits = items.where(many | (n > 2 * OVERLAP))
    others = [c for c in items.columns if c not in ("path", "pages", "w0", "w1")]
    return splits.select(*others, F.explode(F.array(left, right)).alias("c")).select(*others, "c.*")


def halve_tree(items: DataFrame, levels: int | None = None) -> DataFrame:
    """Items with all their descendants, or those down to a level; each level is one projection, no join.

    Without levels it goes on until nothing can be halved: floor(log2(n - 2 * OVERLAP)) + 1 levels
    for n words, and about four rows a word. Levels are checkpointed then.
    """
    out = level = items
    if levels is None:
        ensure_checkpoint_dir(items.sparkSession)
        while not (level := halves(level).checkpoint()).isEmpty():
            out = out.unionByName(level)
        return out
    for _ in range(levels):
        level = halves(level)
        out = out.unionByName(level)
    return out


def batch_summaries(chunks: DataFrame) -> DataFrame:
    """(doc_id, batch_idx, ...): longest call and sums of tokens of a batch's calls."""
    sums = [F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cache_creation_input_tokens", "cache_read_input_tokens")]
    return chunks.groupBy("doc_id", "batch_idx").agg(F.max("duration_ms").alias("duration_ms"), *sums)
