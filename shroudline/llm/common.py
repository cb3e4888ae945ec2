"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import ensure_checkpoint_dir  # noqa: F401
from ..functions.tables import fresh, table  # noqa: F401

#: Rows and bytes of text that one step inside a task handles at most; a longer single text is a step of its own.
STEP_ROWS, STEP_BYTES = 512, 8_000_000


def held_out(doc_id: str | Column) -> Column:
    """True where crc32 of the id's decimal text is divisible by five; such rows are never learned from. Null ids are held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: A key with more than this share of all rows, or half of an average task's share if that is less, counts as hot.
HOT_SHARE = 1 / 2000


def join_sized(rows: DataFrame, sized: DataFrame, key: str, count: str, salt: str | Column) -> DataFrame:
    """rows left-joined with sized, which has one row for each value of the column key (a long, or a text that is no number), and how many rows have it (count).

    The hot keys, fewer than 2,000 or twice the shuffle partitions, are broadcast. All rows are then joined with the other keys by a
    shuffle in which rows of a hot key have a key made of the salt instead, so that no task gets many of
    them; what they might meet there gives way to what the broadcast gave. The column count is left out.
    sized is read three times: it should be a checkpoint.
    """
    values = [c for c in sized.columns if c not in (key, count)]
    total = sized.agg(F.sum(count)).first()[0] or 0
    least = total * min(HOT_SHARE, 0.5 / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot, at, cold = fresh("hot", rows, sized), fresh("at", rows, sized), fresh("cold", rows, sized)
    packed = F.struct(*values)
    # sum(count) is total, so that there are fewer than total / least hot keys.
    few = sized.where(F.col(count) > least).select(key, packed.alias(hot))
    many = sized.where(F.col(count) <= least).select(F.col(key).alias(at), packed.alias(cold))
    salted = F.when(F.col(hot).isNull(), F.col(key)).otherwise(F.xxhash64(F.lit(key), salt).cast(rows.schema[key].dataType))
    joined = rows.join(F.broadcast(few), key, "left").withColumn(at, salted).join(many, at, "left")
    got = F.coalesce(hot, cold)
    return joined.select(*rows.columns, *[got[v].alias(v) for v in values])


def steps(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold a bounded amount of text each."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        while at < n:
            end, size = at, 0
            while end < n and end - at < STEP_ROWS and (end == at or size + sizes[end] <= STEP_BYTES):
                size += int(sizes[end])
                end += 1
            yield batch.slice(at, end - at)
            at = end


def map_text(df: DataFrame, text_col: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Apply ``make()``'s function, built once per task, to bounded slices of the Arrow batches of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for part in steps(batches, text_col):
            yield apply(part)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, text_col: str = "text") -> list[str]:
    """The texts as str; null counts as empty."""
    return [x or "" for x in batch.column(text_col).to_pylist()]


def recount(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with the column of text lengths, if there is one, set to the texts' lengths; null for null texts."""
    if count_col not in docs.columns:
        return docs
    return docs.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType))
