"""Embedding near-duplicates by an exact metric range join.

Cosine at least t is a distance of at most eps = sqrt(2 - 2 t) between unit vectors. Pivots from a
bounded sample part the vectors into cells: a core holds what lies within eps / 2 of a pivot in a
dense place, a shell what is nearest to one of the other pivots. The triangle inequality says which
cells a vector may have partners in, and it is copied to the blocks of these only. Each pair of
blocks is a tile that is joined on its own, by matrix products over a bounded number of rows. The rows
of a core are all linked with each other, again by the triangle inequality, and are counted, not compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import usable
from .common import ensure_checkpoint_dir, join_sized, table
from .components import components

#: Cosine from which on two vectors link.
THRESHOLD = 0.95
#: Vectors that pivots are chosen from (about as many), pivots of either kind at most, vectors of the sample within eps / 2 that make a place dense.
SAMPLE, MOST_PIVOTS, DENSE = 4096, 1024, 4
#: Rows of a block at most; a smaller table is cut into MIN_BLOCKS blocks, so that there is work for all cores, but not below LEAST_ROWS rows.
BLOCK_ROWS, MIN_BLOCKS, LEAST_ROWS = 8192, 12, 256
#: Rows that one matrix product has on its left side, and rows that routing gives out at once.
SLICE, ROUTED = 512, 50_000
#: Distances are compared with this margin, far above their rounding.
MARGIN = 1e-6


def unit(raw: list[bytes], dims: int, kind: str) -> np.ndarray:
    """Vectors (the bytes of their components) in double precision, scaled to length one."""
    x = np.zeros((len(raw), dims))
    for row, b in zip(x, raw):
        v = np.frombuffer(b, dtype=kind)
        row[: len(v)] = v
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def choose_pivots(sample: np.ndarray, shells: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(dense, others): places of the sample with most vectors within eps / 2, over eps apart, and the first of the rest."""
    left, dense = np.ones(len(sample), dtype=bool), []
    near = np.concatenate([(distances(sample[a : a + SLICE], sample) <= eps / 2).sum(axis=1) for a in range(0, len(sample), SLICE)] or [np.zeros(0, dtype=int)])
    for i in np.argsort(-near, kind="stable"):
        if near[i] < DENSE or len(dense) == MOST_PIVOTS:
            break
        if left[i]:
            dense.append(sample[i])
            left &= distances(sample, sample[i : i + 1])[:, 0] > eps
    rest = sample[left] if left.any() else sample[:1]
    return np.array(dense).reshape(-1, sample.shape[1]), rest[: max(1, min(shells, MOST_PIVOTS))]


class Cells:
    """Pivots, and what is known of their cells once these are counted. Cells of dense pivots come first."""

    def __init__(self, dense: np.ndarray, others: np.ndarray, eps: float):
        self.dense, self.pivots, self.eps = len(dense), np.concatenate([dense, others]), eps

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its distance from the pivot."""
        d = distances(x, self.pivots)
        cell = self.dense + d[:, self.dense :].argmin(axis=1)
        if self.dense:
            core = d[:, : self.dense].argmin(axis=1)
            cell = np.where(d[np.arange(len(x)), core] <= self.eps / 2 - MARGIN, core, cell)
        return cell, d[np.arange(len(x)), cell]

    def counted(self, sizes: dict[int, tuple[int, float, float]], rows: int) -> Cells:
        """With blocks of at most about so many rows; sizes: number of vectors, least and greatest distance of each cell that has any."""
        k = len(self.pivots)
        n, self.low, self.high = np.zeros(k, dtype=np.int64), np.full(k, np.inf), np.full(k, -np.inf)
        for cell, (size, low, high) in sizes.items():
            n[cell], self.low[cell], self.high[cell] = size, low, high
        self.parts = -(-n // rows)
        self.base = np.cumsum(self.parts) - self.parts
        self.blocks = int(self.parts.sum())
        return self

    def reach(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Which cells may hold a vector within eps of each x, as far as the triangle inequality tells; a core needs not be looked up for its own rows."""
        d, far = distances(x, self.pivots), self.eps + MARGIN
        may = (d >= self.low - far) & (d <= self.high + far)
        shells = d[:, self.dense :]
        may[:, self.dense :] &= shells <= shells.min(axis=1, keepdims=True) + self.eps + far
        own = np.flatnonzero(cell < self.dense)
        may[own, cell[own]] = False
        return may


def join_tile(x: np.ndarray, weight: np.ndarray, left: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each row the weight of those that it links with, and links that connect the same rows as all do.

    left marks the rows of the first block, which are compared with the others; if there are no others, with each other.
    """
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    alone = not len(b)
    count, label, links = np.zeros(len(x)), np.arange(len(x)), []
    other = x if alone else x[b]
    for at in range(0, len(a), SLICE):
        rows = a[at : at + SLICE]
        first = at if alone else 0  # pairs of earlier rows are done
        r, c = np.nonzero(x[rows] @ other[first:].T >= threshold)
        i, j = rows[r], (a if alone else b)[c + first]
        if alone:
            i, j = i[i < j], j[i < j]
        count += np.bincount(i, weights=weight[j], minlength=len(x)) + np.bincount(j, weights=weight[i], minlength=len(x))
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for s, e in zip(starts, [*starts[1:], len(i)]):
            k, near = int(i[s]), j[s:e]
            labels, nth = np.unique(label[near], return_index=True)
            new = labels != label[k]
            if new.any():
                links += [(k, int(near[m])) for m in nth[new]]
                label[np.isin(label, labels[new])] = label[k]
    return count.astype(np.int64), links


def _vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, key, v): key is a digest of a vector that can link, null for any other."""
    v = F.col(vector_col)
    able = usable(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    digest = F.concat(F.lit("v"), F.hex(F.xxhash64(v)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), v)))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(able, digest).alias("key"), v.alias("v"))


def _bytes(nodes: DataFrame, kind: str) -> DataFrame:
    """nodes with their vectors as bytes (x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, ends = v.flatten().to_numpy().astype(kind), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())])
            x = pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "rep", "n", "node")], x], names=["key", "rep", "n", "node", "x"])

    return nodes.mapInArrow(run, "key string, rep long, n long, node long, x binary")


def _placed(nodes: DataFrame, cells: Cells, dims: int, kind: str) -> DataFrame:
    """(node, n, cell, d, x)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d = cells.place(unit(batch.column("x").to_pylist(), dims, kind))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(cell.astype(np.int32)), pa.array(d), batch.column("x")], names=["node", "n", "cell", "d", "x"])

    return nodes.select("node", "n", "x").mapInArrow(run, "node long, n long, cell int, d double, x binary")


def _routed(placed: DataFrame, cells: Cells, dims: int, kind: str) -> DataFrame:
    """(tile, left, node, n, x): each vector once for each tile of its block that it may have partners in. A tile is first block * number of blocks + second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, ROUTED // max(cells.blocks, 1))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                cell, spread = batch.column("cell").to_numpy(), batch.column("spread").to_numpy()
                own = cells.base[cell] + spread % cells.parts[cell]
                r, c = np.nonzero(cells.reach(unit(batch.column("x").to_pylist(), dims, kind), cell))
                parts = cells.parts[c]
                r, first = np.repeat(r, parts), np.repeat(cells.base[c], parts)
                other = first + np.arange(len(r)) - np.repeat(np.cumsum(parts) - parts, parts)
                mine = own[r]
                tile = np.minimum(mine, other) * cells.blocks + np.maximum(mine, other)
                took = batch.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int64)), pa.array(mine <= other), *[took.column(k) for k in ("node", "n", "x")]], names=["tile", "left", "node", "n", "x"])

    # Blocks are dealt by a hash, so that they are of one size.
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 40))
    return placed.select("node", "n", "cell", "x", spread.alias("spread")).mapInArrow(run, "tile long, left boolean, node long, n long, x binary")


def links(nodes: DataFrame, dims: int, kind: str, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, n) of nodes (node, n, x) with n rows each: with b, links that connect the same nodes as all would; without, n other rows that node a links with. A checkpoint.

    A node may have several rows of the second kind. Memory and work of a tile are bounded by block_rows; a table of m blocks
    has m * (m + 1) / 2 tiles at most, less what the triangle inequality spares.
    """
    spark, eps = nodes.sparkSession, math.sqrt(2 - 2 * threshold)
    n = nodes.count()
    rows = min(block_rows, max(LEAST_ROWS, -(-n // MIN_BLOCKS)))
    # A sample by hash, whose size is SAMPLE within its deviation.
    share = min(1.0, SAMPLE / max(n, 1))
    sample = nodes.select("x", F.xxhash64(F.lit(2), "x").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).collect()
    if not sample and not n:
        return spark.createDataFrame([], "a long, b long, n long")
    sample = sample or nodes.select("x", F.lit(0).alias("h")).limit(1).collect()
    picked = unit([bytes(r["x"]) for r in sorted(sample, key=lambda r: (r["h"], bytes(r["x"])))], dims, kind)
    cells = Cells(*choose_pivots(picked, -(-n // rows), eps), eps)
    placed = _placed(nodes, cells, dims, kind).checkpoint()
    found = placed.groupBy("cell").agg(F.count("*").alias("size"), F.min("d").alias("low"), F.max("d").alias("high"), F.sum("n").alias("n"), F.min("node").alias("first")).collect()  # as many as there are pivots
    cells.counted({r["cell"]: (r["size"], r["low"], r["high"]) for r in found}, rows)

    def join(t: pa.Table) -> pa.Table:
        x = unit(t.column("x").to_pylist(), dims, kind)
        node, weight, left = t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("left").to_numpy()
        first, second = divmod(t.column("tile")[0].as_py(), cells.blocks)
        if first != second and left.all():  # nothing of the second block comes near
            count, pairs = np.zeros(len(x), dtype=np.int64), []
        else:
            count, pairs = join_tile(x, weight, left, threshold)
        hit, (i, j) = np.flatnonzero(count), np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        a, b = np.concatenate([node[hit], node[i]]), np.concatenate([np.zeros(len(hit), dtype=np.int64), node[j]])
        counted = np.arange(len(a)) < len(hit)
        return pa.table({"a": pa.array(a), "b": pa.array(b, mask=counted), "n": pa.array(np.concatenate([count[hit], np.zeros(len(i), dtype=np.int64)]), mask=~counted)})

    joined = _routed(placed, cells, dims, kind).groupBy("tile").applyInArrow(join, "a long, b long, n long")
    cores = [(r["cell"], r["n"], r["first"]) for r in found if r["cell"] < cells.dense]
    if cores:
        core = F.broadcast(spark.createDataFrame(cores, "cell int, total long, first long"))  # as many as there are pivots
        both = F.array(F.struct(F.lit(None).cast("long").alias("b"), (F.col("total") - F.col("n")).alias("m")), F.struct(F.col("first").alias("b"), F.lit(None).cast("long").alias("m")))
        own = placed.select("node", "n", "cell").join(core, "cell").select(F.col("node").alias("a"), F.inline(both))
        joined = joined.union(own.where("m > 0 OR a <> b").select("a", "b", F.col("m").alias("n")))
    return joined.checkpoint()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors: how many others it links with, the smallest id that links lead to, whether that is its own.

    Equal vectors are compared once and counted as often as they occur. All links are found, whatever the pivots; on vectors without
    any nearness (as of random directions) the triangle inequality spares nothing and all tiles are joined.
    Cases: vectors that are null, zero, empty or hold a null or a component that is not finite link with nothing; shorter vectors count as filled up with zeros; repeated
    rows link with each other; a row without an id counts, and names its component (null) only where no row of it has an id;
    extra columns are not looked at; an empty table gives no rows.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    kind = "<f8" if "double" in vectors.schema[vector_col].dataType.simpleString() else "<f4"
    rows = _vectors(vectors, id_col, vector_col)
    distinct = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    nodes = _bytes(distinct.withColumn("node", F.monotonically_increasing_id()), kind).checkpoint()
    dims = (nodes.agg(F.max(F.octet_length("x")).alias("b")).first()["b"] or 0) // np.dtype(kind).itemsize
    found = links(nodes, dims, kind, threshold, block_rows)
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "node")
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    rooted = nodes.select("node", "key", "rep", "n").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).checkpoint()
    firsts = rooted.groupBy("root").agg(F.min("rep").alias("first"), F.count("*").alias("size")).checkpoint()
    named = join_sized(rooted, firsts, "root", "size", "node").select("key", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "first").checkpoint()
    out = join_sized(rows.select("vec_id", "key"), named, "key", "n", "vec_id")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_metric(spark, sf_dir):
    """Links, components and representatives of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
able AS MATERIALIZED (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (SELECT a.r AS x, b.r AS y FROM able a JOIN able b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT r, vec_id AS id FROM v UNION SELECT l.y, c.id FROM reach c JOIN links l ON l.x = c.r),
least AS (SELECT r, min(id) AS component_id FROM reach GROUP BY r),
counts AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least USING (r) LEFT JOIN counts USING (r)
"""
