"""Estimated and actual costs of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Output tokens for an input token, in an estimate; ratio of actual to estimated cost that is worth a note. Fixed values.
OUTPUT_SHARE, DIVERGENCE = 0.18, 2.0


def estimate(tokens: Column) -> Column:
    """USD of a call with so many input tokens, by the row's rates."""
    return tokens / 1e6 * F.col("input_per_million") + tokens * OUTPUT_SHARE / 1e6 * F.col("output_per_million")


def actual(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., cost_usd) of calls with rates: integers are summed first, then multiplied once."""
    rates = ["input_per_million", "output_per_million", "cache_write_multiplier", "cache_read_multiplier"]
    total = chunks.groupBy(*by, *rates).agg(*[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cache_creation_input_tokens", "cache_read_input_tokens")])
    cost = (
        F.col("tokens_in") / 1e6 * F.col("input_per_million")
        + F.col("cache_creation_input_tokens") / 1e6 * F.col("input_per_million") * F.col("cache_write_multiplier")
        + F.col("cache_read_input_tokens") / 1e6 * F.col("input_per_million") * F.col("cache_read_multiplier")
        + F.col("tokens_out") / 1e6 * F.col("output_per_million")
    )
    return total.select(*by, cost.alias("cost_usd"))


def totals(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n_calls, ...): sums of the tokens and times of all calls."""
    names = ("tokens_in", "tokens_out", "cache_creation_input_tokens", "cache_read_input_tokens", "duration_ms")
    return chunks.groupBy(*(by or [])).agg(F.count("*").alias("n_calls"), *[F.sum(c).alias(c) for c in names])


def diverged(actual_cost: Column, estimated: Column) -> Column:
    return (estimated > 0) & (actual_cost / estimated > DIVERGENCE)
