"""Tables as they are read, and names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table up to which its rows may be dealt anew over all cores; larger ones have blocks enough.
SMALL = 512 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table sf_dir/name.parquet; if it is small and sits in fewer blocks than half of the cores, its rows are dealt over the cores.

    A Parquet file is split by row groups only, so that one of a few megabytes gives one task, however
    long the work on its rows is. Dealing it costs a shuffle whose size SMALL bounds.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if cores < 2 or size > SMALL:
        return rows
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}", size)
    if key not in _BLOCKS:  # counts the splits that have rows from the files' footers, once for each table
        _BLOCKS[key] = rows.groupBy(F.spark_partition_id()).count().count()
    return rows.repartition(cores) if 0 < 2 * _BLOCKS[key] < cores else rows


#: Blocks of the small tables that were read, by application, path and size.
_BLOCKS: dict[tuple[str, str, int], int] = {}


def fresh(name: str, *frames: DataFrame) -> str:
    """A name for a helper column that no column of the frames has, whatever the case of its letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
