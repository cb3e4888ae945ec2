"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: Rounds whose moves are joined in one plan.
FOLD = 4


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label the vertices of undirected links (a, b long): returns (node, root), one row per vertex that has a link.

    In each round every vertex moves to the neighbour (itself included) that comes first in a
    pseudo-random order, which changes from round to round, so that chains shrink by a constant
    factor whatever their ids. The smallest neighbour is a map-side combined aggregate: a vertex
    with very many links costs one row per task. No adjacency list is built anywhere. Links are
    written to the checkpoint folder after each round, which also cuts lineage.
    An empty link table gives an empty result.
    """
    spark = links.sparkSession
    ensure_checkpoint_dir(spark)
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    moves: list[DataFrame] = []
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = edges.select(F.col("a").alias("node"), order("b").alias("o")).union(edges.select(F.col("b").alias("node"), order("a").alias("o")))
        move = both.groupBy("node").agg(F.min("o").alias("o")).select("node", F.least("o", order("node"))["v"].alias("to")).checkpoint()
        moves.append(move)
        edges = (
            edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
            .checkpoint()
        )
    else:
        raise RuntimeError(f"links did not contract within {max_rounds} rounds")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0].select("node", F.col("to").alias("root"))
    for k, move in enumerate(moves[1:], 1):
        step = move.select(F.col("node").alias("root"), "to")
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        if k % FOLD == 0:
            out = out.checkpoint()
    return out
