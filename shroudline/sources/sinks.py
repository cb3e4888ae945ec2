"""Writes that are seen whole or not at all: published pages, backups, price lists. Paths are those of any Hadoop file system."""

from __future__ import annotations

import json
import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.backups import expired
from . import pricing
from .audit import backup_time


class OutputExists(FileExistsError):
    """The output is there already; the message names a free one."""


class VerificationFailed(RuntimeError):
    """The result still holds what was to be removed."""


class Files:
    """The few operations of a Hadoop file system that are needed here."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def move(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(a), self._path(b)):
            raise OSError(f"{a} could not become {b}")

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def replace(self, new: str, path: str) -> None:
        """Put new in the place of path. What was there stands aside until new is there, and comes back if that fails."""
        aside = f"{path.rstrip('/')}.old-{uuid.uuid4().hex[:8]}"
        old = self.exists(path)
        if old:
            self.move(path, aside)
        try:
            self.move(new, path)
        except BaseException:
            if old and not self.exists(path):
                self.move(aside, path)
            raise
        if old:
            self.remove(aside)

    def write_text(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def free_name(spark: SparkSession, path: str) -> str:
    """path.vN with the number after the highest that is there, 2 if there is none."""
    parent, _, base = path.rstrip("/").rpartition("/")
    found = [int(m[1]) for n in Files(spark, path).names(parent or ".") if (m := re.fullmatch(re.escape(base) + r"\.v(\d+)", n))]
    return f"{path.rstrip('/')}.v{max(found, default=1) + 1}"


def publish(pages: DataFrame, path: str, leaks: DataFrame | None = None, overwrite: bool = False) -> None:
    """Write pages beside path, and move them there if the check finds no leak; nothing stays otherwise.

    leaks is a query over the pages as they were written, or over what goes with them.
    """
    spark = pages.sparkSession
    fs = Files(spark, path)
    if fs.exists(path) and not overwrite:
        raise OutputExists(f"{path} exists; {free_name(spark, path)} is free")
    temp = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex[:8]}"
    try:
        pages.write.parquet(temp)
        if leaks is not None and (bad := leaks.first()) is not None:
            raise VerificationFailed(f"document {bad['doc_id']}: {bad['detail']}")
        fs.replace(temp, path)
    finally:
        if fs.exists(temp):
            fs.remove(temp)


def output_path(spark: SparkSession, source: str, output: str | None = None, *, versioned: bool = False, overwrite: bool = False) -> str:
    """Where the redaction of source goes: output, or the next free version of it (of source without one); versioned and overwrite exclude each other.

    ValueError if both are asked for or the output is the source itself, OutputExists if it is there and may not be written over.
    """
    if versioned and overwrite:
        raise ValueError("a new version overwrites nothing: choose one of the two")
    target = (output or f"{source.rstrip('/')}.redacted").rstrip("/")
    if versioned:
        return free_name(spark, target)
    if target == source.rstrip("/"):
        raise ValueError("the output is the source itself")
    if Files(spark, target).exists(target) and not overwrite:
        raise OutputExists(f"{target} exists; {free_name(spark, target)} is free")
    return target


def session_name(now: datetime | None = None) -> str:
    """A folder name that sorts by time and is its own: the second in UTC and six random hexadecimal digits."""
    return f"{(now or datetime.now(UTC)).strftime('%Y-%m-%dT%H-%M-%SZ')}-{uuid.uuid4().hex[:6]}"


def create_backup(spark: SparkSession, original: str, root: str, now: datetime | None = None) -> str:
    """Copy the table at original to a folder of its own under root, with a manifest; the folder's name."""
    name = session_name(now)
    spark.read.parquet(original).write.parquet(f"{root}/{name}/copy")
    manifest = {"timestamp": name, "original_path": original, "copy_path": f"{root}/{name}/copy"}
    Files(spark, root).write_text(f"{root}/{name}/manifest.json", json.dumps(manifest))
    return name


def sweep_backups(spark: SparkSession, root: str, retention_hours: int, now: datetime | None = None) -> int:
    """Delete the backups under root that operators.backups.expired names; their number."""
    fs = Files(spark, root)
    names = spark.createDataFrame([(n,) for n in fs.names(root)], "session_dir string")
    limit = F.lit((now or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    due = expired(names.withColumn("ts", backup_time(F.col("session_dir"))), retention_hours, limit).collect()  # as many as there are folders
    for row in due:
        fs.remove(f"{root}/{row['session_dir']}")
    return len(due)


def refresh_pricing(spark: SparkSession, source: str, target: str) -> None:
    """Put a price list in the place of another if all its rates are there; ValueError otherwise."""
    rows = pricing.load(spark, source).collect()  # as many as there are models
    if not rows or any(r["input_per_million"] is None or r["output_per_million"] is None for r in rows):
        raise ValueError(f"{source} is no price list")
    out: dict = {"providers": {}}
    for r in rows:
        rates = {k: v for k, v in r.asDict().items() if k not in ("provider", "model")}
        out["providers"].setdefault(r["provider"], {})[r["model"]] = rates
    fs = Files(spark, target)
    fs.write_text(f"{target}.tmp", json.dumps(out))
    fs.replace(f"{target}.tmp", target)
