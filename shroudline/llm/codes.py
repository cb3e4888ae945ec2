"""Vector codes: integer product quantisation with partial-distance search.

Vectors become integers and are cut into parts; each part has a codebook that a few rounds of
assignment and averaging fit to all vectors. A round is one pass in which every task looks its
parts up and adds them to sums, so that a task gives as many rows as the codebooks have components.
A lookup goes through the dimensions in the order of the codebook's variance and drops an entry
for a vector as soon as the distance so far exceeds the vector's best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_ROWS, ensure_checkpoint_dir, join_sized, steps, table

#: Parts of a vector, entries of a codebook, rounds, and the scale of the integers. Fixed values.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are held within this range, so that the squared distances of 64 dimensions fit a long.
MOST = 2**27


def usable(vector: str | Column) -> Column:
    """True for vectors that are neither null nor hold a null or a component that is no finite number."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True))


def quantised(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, key, x): the integers floor(SCALE * component) as bytes of 32-bit numbers, filled up with zeros to dims.

    Rows that aren't usable are left out. key tells the rows apart within one checkpoint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, STEP_ROWS) for whole in batches for at in range(0, whole.num_rows, STEP_ROWS)):
            v, x = batch.column("v"), np.zeros((batch.num_rows, dims), dtype=np.float64)
            sizes = v.value_lengths().to_numpy()
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x[np.repeat(np.arange(len(sizes)), sizes), place] = flat
            whole = np.clip(np.floor(x * SCALE), -MOST, MOST).astype("<i4")
            kept = [batch.column(c) for c in ("vec_id", "label", "key")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in whole], pa.binary())], names=["vec_id", "label", "key", "x"])

    label = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("null"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("v")).where(usable("v"))
    return rows.withColumn("key", F.monotonically_increasing_id()).mapInArrow(run, "vec_id long, label string, key long, x binary")


def search_part(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest entry of a codebook, the first of equally near ones, and its squared distance.

    Dimensions come in descending variance of the codebook. Entries are tried in their order; the rows
    whose distance so far strictly exceeds the best complete one are masked out of what is left of the entry.
    """
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    columns, entries = np.ascontiguousarray(x[:, order].T.astype(np.int64)), book[:, order]
    best = np.full(len(x), np.iinfo(np.int64).max)
    code = np.zeros(len(x), dtype=np.int64)
    for e, entry in enumerate(entries):
        rows, so_far = None, np.zeros(len(x), dtype=np.int64)
        for column, component in zip(columns, entry):
            d = (column if rows is None else column[rows]) - component
            so_far += d * d
            near = so_far <= (best if rows is None else best[rows])
            if not near.all():
                rows = np.flatnonzero(near) if rows is None else rows[near]
                so_far = so_far[near]
                if not len(rows):
                    break
        rows = np.arange(len(x)) if rows is None else rows
        closer = so_far < best[rows]  # an equally near entry that comes later gives way
        best[rows[closer]], code[rows[closer]] = so_far[closer], e
    return code, best


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype="<i4").reshape(batch.num_rows, dims)


def _sums(rows: DataFrame, book: np.ndarray) -> DataFrame:
    """(part, entry, at, total, n): the sums of the parts that each entry is nearest to, by position."""
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(book.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for step in steps([batch], "x"):
                x = _matrix(step, parts * width)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    code, _ = search_part(own, book[p])
                    np.add.at(total[p], code, own)
                    n[p] += np.bincount(code, minlength=entries)
        p, e, at = (a.ravel() for a in np.indices(book.shape))
        kept = np.repeat(n.ravel(), width) > 0
        columns = [p[kept], e[kept], at[kept], total.ravel()[kept], np.repeat(n.ravel(), width)[kept]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "at", "total", "n"])

    return rows.select("x").mapInArrow(run, "part long, entry long, at long, total long, n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(rows: DataFrame, dims: int, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, position) of quantised rows: the parts of the rows with the smallest ids, then rounds of floored means."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(ENTRIES).collect()  # sixteen rows
    book = np.array([np.frombuffer(bytes(r["x"]), dtype="<i4") for r in first], dtype=np.int64).reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(rows, book).collect():  # as many as the codebooks have components
            book[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return book


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The codes (vec_id, code, error, label_error), one row for each usable vector, and the codebooks.

    The code has two hexadecimal digits a part; error is the squared distance to the entries, label_error its sum
    over the rows of the same label.
    Cases: rows with a null vector, or one with a component that is null or not finite, are left out; vectors shorter
    than the longest, or whose length is no multiple of the parts, are filled up with zeros; components beyond
    MOST / SCALE are held there; fewer than sixteen rows give as many entries; an entry that no part is
    nearest to stays as it is; rows without an id come last where the first ids begin the codebooks, equal ids in the order of their
    vectors; repeated rows stay rows; null labels are one label; a sum that fits no long is null; extra columns are not looked at; an
    empty table gives no rows.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    schema = "vec_id long, code string, error long, label string, key long"
    longest = vectors.where(usable(vector_col)).agg(F.max(F.size(vector_col)).alias("n")).first()["n"]
    if longest is None:
        empty = vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long")
        return empty, np.zeros((PARTS, 0, 0), dtype=np.int64)
    dims = max(-(-longest // PARTS), 1) * PARTS
    rows = quantised(vectors, dims, id_col, vector_col, label_col).checkpoint()
    book = fit(rows, dims, rounds)
    width = dims // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps([batch], "x"):
                x = _matrix(step, dims)
                found = [search_part(x[:, p * width : (p + 1) * width], book[p]) for p in range(PARTS)]
                code = np.array([c for c, _ in found], dtype=np.uint8).T
                error = sum(d for _, d in found)
                arrays = [step.column("vec_id"), pa.array([c.tobytes().hex() for c in code]), pa.array(error), step.column("label"), step.column("key")]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "code", "error", "label", "key"])

    coded = rows.mapInArrow(run, schema).checkpoint()
    totals = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("size")).checkpoint()
    return join_sized(coded, totals, "label", "size", "key").select("vec_id", "code", "error", "label_error"), book


def op13_codes(spark, sf_dir):
    """The codes of all embeddings, their errors, and a digest of the codebooks."""
    codes, book = encode(table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(digest(book)))


def _sql() -> str:
    """The SQL of op13_codes: a round is one table of nearest entries and one of means."""
    nearest = lambda k: f"""
near{k} AS MATERIALIZED (
  SELECT id, part, CAST(min_by(entry, (d, entry)) AS BIGINT) AS entry, min(d) AS d FROM (
    SELECT p.id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM parts p JOIN book{k} b USING (part, pos) GROUP BY p.id, p.part, b.entry
  ) GROUP BY id, part
)"""  # noqa: E731
    means = lambda k: f"""
mean{k} AS (SELECT n.part, n.entry, p.pos, CAST(floor(sum(p.x) / count(*)) AS BIGINT) AS x FROM near{k} n JOIN parts p USING (id, part) GROUP BY n.part, n.entry, p.pos),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry, pos))"""  # noqa: E731
    rounds = ",".join(f"{nearest(k)},{means(k)}" for k in range(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
  SELECT id, (i - 1) // (len(v) // {PARTS}) AS part, (i - 1) % (len(v) // {PARTS}) AS pos, CAST(floor({SCALE} * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM kept)
),
book0 AS (SELECT part, id - 1 AS entry, pos, x FROM parts WHERE id <= {ENTRIES}),{rounds},{nearest(ROUNDS)},
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY id),
book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM book{ROUNDS})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, book.h AS codebooks_sha256
FROM kept k JOIN coded c USING (id), book
"""


OP13_SQL = _sql()
