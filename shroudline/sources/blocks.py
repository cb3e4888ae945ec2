"""Backups of files by the content of their blocks.

A file is cut into blocks, and a block is kept once under the hash of its bytes, whatever files and
backups hold it. A backup is a table of its files: size, the hash of all bytes, the hashes of the blocks
in order, and the root of the tree over them. So a second backup of an unchanged file stores nothing.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import ensure_checkpoint_dir
from ..functions.stores import file_system
from .sinks import Files, session_name

#: Bytes of a block.
BLOCK = 1 << 20

_BLOCKS = "path string, nth int, digest string, size long, content binary"


def _files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size) of the files under a path; the bytes are read where they are needed. Empty files are left out, as Spark leaves them out."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))


def cut(files: DataFrame, block: int = BLOCK, with_content: bool = True) -> DataFrame:
    """(path, nth, digest, size, content) of the blocks of files (path), read block by block: a task holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = file_system(path)
                with fs.open_input_stream(place) as source:
                    nth = 0
                    while content := source.read(block):
                        row = [[path], [nth], [hashlib.sha256(content).hexdigest()], [len(content)], [content if with_content else None]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()))], names=[c.split()[0] for c in _BLOCKS.split(", ")])
                        nth += 1

    return files.select("path").mapInArrow(run, _BLOCKS)


def tree_root(digests: list[str]) -> str:
    """The root of the tree over blocks: pairs of neighbours are hashed together, level by level; one without a neighbour rises as it is."""
    level = [bytes.fromhex(d) for d in digests]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex()


def content_hashes(spark: SparkSession, path: str, glob: str = "*", block: int = BLOCK) -> DataFrame:
    """(path, size, sha256, tree_sha256, n_blocks) of the bytes of each file under a path: one hash of them all, and the root over those of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                fs, place = file_system(path)
                whole, digests, size = hashlib.sha256(), [], 0
                with fs.open_input_stream(place) as source:
                    while content := source.read(block):
                        whole.update(content)
                        digests.append(hashlib.sha256(content).hexdigest())
                        size += len(content)
                rows.append({"path": path, "size": size, "sha256": whole.hexdigest(), "tree_sha256": tree_root(digests), "n_blocks": len(digests)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("tree_sha256", pa.string()), ("n_blocks", pa.int64())]))

    return _files(spark, path, glob).mapInArrow(run, "path string, size long, sha256 string, tree_sha256 string, n_blocks long")


def create(spark: SparkSession, path: str, root: str, now: datetime | None = None, glob: str = "*", block: int = BLOCK) -> tuple[str, int]:
    """Back up the files under a path; the backup's name, and how many blocks are new.

    First all blocks are hashed; only files with a block that isn't there yet are read again, and each new block is
    written once. The table of files comes last: without it there is no backup.
    """
    ensure_checkpoint_dir(spark)
    root, name = root.rstrip("/"), session_name(now)
    tables = Files(spark, root)
    known = spark.read.parquet(f"{root}/blocks").select("digest") if tables.names(f"{root}/blocks") else spark.createDataFrame([], "digest string")
    places = cut(_files(spark, path, glob), block, with_content=False).drop("content").checkpoint()
    new = places.select("digest").distinct().join(known, "digest", "left_anti").checkpoint()
    n_new = new.count()
    if n_new:
        # Of equal new blocks the first place gives the bytes.
        first = places.join(new, "digest").groupBy("digest").agg(F.min(F.struct("path", "nth")).alias("at")).select("at.path", "at.nth", "digest")
        sources = first.select("path").distinct()
        written = cut(sources, block).join(first.select("path", "nth"), ["path", "nth"]).select("digest", "size", "content")
        written.write.mode("append").parquet(f"{root}/blocks")
    of = F.transform(F.array_sort(F.collect_list(F.struct("nth", "digest"))), lambda b: b["digest"])
    manifest = places.groupBy("path").agg(F.sum("size").alias("size"), of.alias("blocks"))
    manifest.write.parquet(f"{root}/backups/{name}")
    return name, n_new


def backups(spark: SparkSession, root: str) -> list[str]:
    """The names of the backups that are whole, in the order of their times."""
    fs = Files(spark, root)
    return [n for n in fs.names(f"{root.rstrip('/')}/backups") if fs.exists(f"{root.rstrip('/')}/backups/{n}/_SUCCESS")]


def restore(spark: SparkSession, root: str, name: str, source: str, target: str) -> int:
    """Write the files of a backup of source below target, and check the bytes of each block; the number of files.

    The blocks of a file come to one task in order and are written one by one.
    """
    root = root.rstrip("/")
    manifest = spark.read.parquet(f"{root}/backups/{name}")
    rows = manifest.select("path", F.posexplode("blocks").alias("nth", "digest")).join(spark.read.parquet(f"{root}/blocks").select("digest", "content").dropDuplicates(["digest"]), "digest")
    prefix = source.split("://")[-1].removeprefix("file:").rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, None
        done: list[str] = []
        for batch in batches:
            for path, digest, content in zip(*(batch.column(c).to_pylist() for c in ("path", "digest", "content"))):
                if hashlib.sha256(content).hexdigest() != digest:
                    raise ValueError(f"{path}: a block of the backup is damaged")
                if path != at:
                    if out is not None:
                        out.close()
                    fs, place = file_system(posixpath.join(target, path.split(prefix, 1)[-1].lstrip("/")))
                    fs.create_dir(posixpath.dirname(place), recursive=True)
                    at, out = path, fs.open_output_stream(place)
                    done.append(path)
                out.write(content)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    ordered = rows.repartition("path").sortWithinPartitions("path", "nth").select("path", "digest", "content")
    return ordered.mapInArrow(run, "path string").checkpoint().count()
