"""Backups: which is the latest, how old they are, which are due; and names for new versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(backups: DataFrame) -> DataFrame:
    """(original_path, session_dir, copy_path): of each original the backup whose folder's name is last."""
    row = F.struct("session_dir", "copy_path")
    return backups.groupBy("original_path").agg(F.max_by(row, "session_dir").alias("b")).select("original_path", "b.*")


def latest_of(backups: DataFrame, original_path: str) -> DataFrame:
    """The latest backup of one original; paths are compared as they are written, which are absolute ones in manifests."""
    return latest(backups.where(F.col("original_path") == original_path))


def newest(backups: DataFrame, session_dirs: DataFrame) -> DataFrame:
    """The backup in the folder whose name is last among all (session_dir); none if that folder has no manifest, and so is not among the backups."""
    last = session_dirs.agg(F.max("session_dir").alias("session_dir"))
    return backups.join(F.broadcast(last), "session_dir", "left_semi")  # one row


def with_audit(backups: DataFrame, sessions: DataFrame) -> DataFrame:
    """Backups with the audit log of the same name (sessions: session_key and its fields), null where there is none."""
    return backups.join(sessions.withColumnRenamed("session_key", "session_dir"), "session_dir", "left")


def by_session(backups: DataFrame, session_dir: str) -> DataFrame:
    return backups.where(F.col("session_dir") == session_dir)


def age_hours(ts: Column, now: Column) -> Column:
    """Whole hours from ts to now."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 3600)


def age_label(ts: Column, now: Column) -> Column:
    return F.when(ts.isNull(), "of unknown age").otherwise(F.concat(age_hours(ts, now).cast("string"), F.lit(" hours old")))


def expired(backups: DataFrame, retention_hours: int, now: Column) -> DataFrame:
    """Backups older than retention_hours; none if it is 0, and never one whose name has no time."""
    if retention_hours == 0:
        return backups.limit(0)
    return backups.where(F.unix_timestamp("ts") < F.unix_timestamp(now) - retention_hours * 3600)


def next_versions(files: DataFrame) -> DataFrame:
    """files (base, name): the number after the highest "base.vN" of each base, 2 if there is none."""
    base = F.regexp_extract("name", r"^(.+)\.v(\d+)$", 1)
    n = F.when(base == F.col("base"), F.regexp_extract("name", r"^(.+)\.v(\d+)$", 2).try_cast("int"))
    return files.groupBy("base").agg(F.coalesce(F.max(n) + 1, F.lit(2)).alias("next_version"))
