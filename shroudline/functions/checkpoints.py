"""The folder of checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; on a local master without one, as in tests, take a temporary folder.

    On a cluster a folder of one machine would be lost with it: there the setting is required.
    """
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the checkpoint folder and read from there.

    checkpoint() writes rows as they are in memory, uncompressed; of many narrow columns it takes a multiple of this.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
