"""A sink that publishes documents one by one: those that pass appear, those that don't are held back.

Tasks write the documents that pass into files nobody reads yet, and what is wrong with the others
into files beside them. Only when all tasks are done does the driver put one entry into a log, by an
exclusive creation; an entry names the files of its run, and readers read what the log names. So an
attempt that is lost leaves files that are never seen, and a run that is done twice counts once.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.stores import create, file_system

#: What is wrong with a document, from its rows; an empty list lets it pass. An exception holds it back.
Check = Callable[[pa.Table], list[dict]]

HELD = pa.schema([("doc_id", pa.int64()), ("leaks", pa.list_(pa.struct([("page", pa.int32()), ("kind", pa.string()), ("detail", pa.string())])))])
#: Bytes of documents that are written as one group of rows.
GROUP_BYTES = 32 << 20




def found_leaks(document: pa.Table) -> list[dict]:
    """The leaks that the rows of a document carry in their column leaks."""
    return [x for row in document.column("leaks").to_pylist() for x in row or []] if "leaks" in document.column_names else []


@dataclass
class Written(WriterCommitMessage):
    """The files of a task, with the number of documents in each."""

    data: str | None
    held: str | None
    n_data: int
    n_held: int


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each document, one document at a time; rows come sorted by document."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids, at = batch.column("doc_id").to_pylist(), 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[at]:
                if held and held[0].column("doc_id")[0].as_py() != ids[at]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(at, i - at))
                at = i
    if held:
        yield pa.Table.from_batches(held)


class _Parts:
    """A Parquet file that is there once it has rows."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.writer, self.rows, self.size, self.n = fs, path, None, [], 0, 0

    def add(self, rows: pa.Table) -> None:
        self.rows.append(rows)
        self.size += rows.nbytes
        self.n += 1
        if self.size >= GROUP_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            table = pa.concat_tables(self.rows)
            if self.writer is None:
                self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
                self.stream = self.fs.open_output_stream(self.path)
                self.writer = pq.ParquetWriter(self.stream, table.schema)
            self.writer.write_table(table)
            self.rows, self.size = [], 0

    def close(self) -> str | None:
        self.flush()
        if self.writer is None:
            return None
        self.writer.close()
        self.stream.close()
        return posixpath.basename(self.path)


class GateWriter(DataSourceArrowWriter):
    """Two phases: tasks write and judge, the driver's commit makes visible what passed."""

    def __init__(self, path: str, run_id: str, schema: StructType, overwrite: bool, check: Check, commit_log: Callable[[dict], None]):
        self.path, self.run_id, self.overwrite, self.check, self.commit_log = path, run_id, overwrite, check, commit_log
        self.columns = [f.name for f in schema if f.name != "leaks"]
        self.schema = to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        name = uuid.uuid4().hex  # another one for each attempt
        data, held = _Parts(fs, f"{root}/data/{self.run_id}/{name}.parquet"), _Parts(fs, f"{root}/held/{self.run_id}/{name}.parquet")
        for document in _documents(iterator):
            try:
                wrong = self.check(document)
            except Exception as error:  # noqa: BLE001 - whatever breaks over a document, only that one is held back
                wrong = [{"page": 0, "kind": "broken", "detail": f"{type(error).__name__}: {error}"}]
            if wrong:
                doc_id = document.column("doc_id")[0].as_py()
                held.add(pa.Table.from_pylist([{"doc_id": doc_id, "leaks": [{k: x.get(k) for k in ("page", "kind", "detail")} for x in wrong]}], HELD))
            else:
                data.add(document.select(self.columns))
        return Written(data.close(), held.close(), data.n, held.n)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        self.commit_log({
            "run_id": self.run_id, "replaces": self.overwrite,
            "data": sorted(m.data for m in done if m.data), "held": sorted(m.held for m in done if m.held),
            "n_data": sum(m.n_data for m in done), "n_held": sum(m.n_held for m in done),
        })

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        if self.run_id not in {x["run_id"] for x in _log(fs, root)}:  # a run that is done keeps its files
            for part in ("data", "held"):
                folder = f"{root}/{part}/{self.run_id}"
                if fs.get_file_info(folder).type == pafs.FileType.Directory:
                    fs.delete_dir(folder)


def _log(fs: pafs.FileSystem, root: str) -> list[dict]:
    """The entries of the log in order."""
    folder = f"{root}/log"
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        return []
    names = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(folder)) if i.path.endswith(".json"))
    return [json.loads(fs.open_input_stream(n).read()) for n in names]


def _append(path: str, entry: dict) -> None:
    """Add an entry to the log unless its run is there. Entries are numbered, and a number is given once: a name that is taken is refused by the store."""
    fs, root = file_system(path)
    fs.create_dir(f"{root}/log", recursive=True)
    while True:
        entries = _log(fs, root)
        if entry["run_id"] in {x["run_id"] for x in entries}:
            return
        if create(fs, f"{root}/log/{len(entries):010d}.json", json.dumps(entry).encode()):
            return


def source(check: Check = found_leaks, name: str = "gated_documents") -> type[DataSource]:
    """The data source of a check, to be registered: df.write.format(name).mode("append").option("run_id", ...).save(path)."""

    class Gate(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: StructType, overwrite: bool) -> GateWriter:
            path, run_id = self.options["path"].rstrip("/"), self.options.get("run_id") or uuid.uuid4().hex
            if "doc_id" not in schema.names:
                raise ValueError("a document is told by a column doc_id")
            return GateWriter(path, run_id, schema, overwrite, check, lambda entry: _append(path, entry))

    return Gate


def publish(pages: DataFrame, path: str, run_id: str | None = None, check: Check = found_leaks, overwrite: bool = False) -> dict:
    """Publish the documents of pages (doc_id, and leaks if the check looks at them) that pass; the numbers of published and held ones.

    All rows of a document go to one task, in the order of their pages; a task holds one document at a
    time. A leak in a document, or a check that breaks over it, holds back that one. A run whose id the log
    has is not published again. With overwrite the run takes the place of what is there, at once.
    """
    spark = pages.sparkSession
    run_id = run_id or uuid.uuid4().hex
    name = f"gated_documents_{run_id}"
    fs, root = file_system(path.rstrip("/"))
    if run_id not in {x["run_id"] for x in _log(fs, root)}:
        spark.dataSource.register(source(check, name))
        order = ["doc_id", *(["page"] if "page" in pages.columns else [])]
        rows = pages.repartition("doc_id").sortWithinPartitions(*order)
        rows.write.format(name).mode("overwrite" if overwrite else "append").option("run_id", run_id).save(path)
    entry = next(x for x in _log(fs, root) if x["run_id"] == run_id)
    return {k: entry[k] for k in ("run_id", "n_data", "n_held")}


def _listed(spark: SparkSession, path: str, part: str) -> list[str]:
    fs, root = file_system(path.rstrip("/"))
    out: list[str] = []
    for entry in _log(fs, root):
        if entry["replaces"]:
            out = []
        out += [f"{path.rstrip('/')}/{part}/{entry['run_id']}/{name}" for name in entry[part]]
    return out


def read(spark: SparkSession, path: str, part: str = "data") -> DataFrame:
    """The published pages, or with part "held" the documents that were held back and why: (doc_id, leaks)."""
    files = _listed(spark, path, part)
    if not files:
        return spark.createDataFrame([], "doc_id long" if part == "data" else "doc_id long, leaks array<struct<page:int,kind:string,detail:string>>")
    return spark.read.parquet(*files)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete what no entry of the log names: what attempts left that were lost, and what was replaced. Not while a run is writing. The number of files."""
    fs, root = file_system(path.rstrip("/"))
    kept = {p.split("://")[-1].rpartition("/")[2] for part in ("data", "held") for p in _listed(spark, path, part)}
    gone = 0
    for part in ("data", "held"):
        if fs.get_file_info(f"{root}/{part}").type == pafs.FileType.Directory:
            for info in fs.get_file_info(pafs.FileSelector(f"{root}/{part}", recursive=True)):
                if info.type == pafs.FileType.File and info.base_name not in kept:
                    fs.delete_file(info.path)
                    gone += 1
    return gone
