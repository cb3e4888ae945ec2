"""Token-count rollups that signed deltas keep up to date.

A store is a folder with a log of commits and two kinds of Parquet tables: the deltas (source,
lang, version, docs, tokens: signed sums of a batch) and the ledger (the rows that a batch wrote
for single documents, so that a later delete or revision knows what to take back). Totals are the
sums of the deltas of all committed batches.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, join_sized, map_text, table, texts

#: Operations: insert adds a document under a version, revise replaces its row, delete takes it back.
OPERATIONS = ("insert", "revise", "delete")
KEYS = ("source", "lang", "version")
#: Batches after which a commit makes a snapshot of ledger and totals, so that reads never list more of them.
SNAPSHOT_EVERY = 16

#: Documents of a batch up to which their ids are sent to the tasks that read the ledger, so that no other row of it is shuffled.
FEW_IDS = 200_000
#: Seconds after which a table that no reader starts from any more may go: longer than any read or commit takes.
GRACE_SECONDS = 86_400

_LEDGER = "doc_id long, version string, source string, lang string, tokens long, live boolean, batch long"
_DELTAS = "source string, lang string, version string, docs long, tokens long"


class RollupStore:
    """Delta-maintained totals of token counts by source, language and tokenizer version.

    The log has one small file for each commit, numbered without gaps. A commit writes its tables
    into folders of its own, computes its deltas against the log that it read, and puts its file
    under the next number; if another writer took that number, it computes them anew. So a batch
    counts whole and once, and writers don't lose each other's deltas.
    Batches may come in any order: of the events of all batches on one document and version the
    one of the highest batch is in force, and a batch that comes late changes only what no higher
    one has touched. Totals and ledger are those of the batches in their order.

    Cases: null sources and languages are keys of their own; a null count adds no tokens, but a
    document; events with a null id or version or an unknown operation are refused (ignored);
    of several events of one batch on one document and version the one with the highest seq
    counts, of equal ones the last in the order of op, source, lang and tokens; inserting what is there
    replaces it, like a revision; deleting or revising what isn't there takes nothing back (a revision
    then inserts); an empty batch commits and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, snapshot_every: int = SNAPSHOT_EVERY):
        self.spark, self.folder, self.snapshot_every = spark, folder.rstrip("/"), snapshot_every
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str) -> str:
        return posixpath.join(self.folder, *parts)

    def _path(self, *parts: str):
        return self._hadoop.Path(self._at(*parts))

    def _entry(self, number: int) -> dict:
        stream = self._fs.open(self._path("log", f"{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _log(self) -> tuple[int, list[int], list[dict]]:
        """The last commit's number, the numbers of all batches, and the entries to read: the last snapshot, if there is one, and the batches after it."""
        path = self._path("log")
        names = [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []
        last, entries = max((int(n) for n in names if n.isdigit()), default=0), []
        for number in range(last, 0, -1):
            entries.append(self._entry(number))
            if "batches" in entries[-1]:
                break
        batches = [b for e in entries for b in e.get("batches", [e.get("batch")])]
        return last, sorted(batches), entries

    def _append(self, number: int, entry: dict) -> bool:
        """Put an entry under a number of the log, whole; False if the number is taken."""
        temp = self._path("log", f"tmp-{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(temp, self._path("log", f"{number:012d}"), none)  # never over a file that is there
        except Py4JJavaError as error:
            self._fs.delete(temp, False)
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def batches(self) -> list[int]:
        """Numbers of the committed batches, in order."""
        return self._log()[1]

    def _read(self, name: str, schema: str, entries: list[dict]) -> DataFrame:
        """The tables of some commits, in one scan."""
        paths = [self._at(name, e["folder"]) for e in entries]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _winners(self, entries: list[dict], within: tuple | None = None, only: DataFrame | None = None) -> DataFrame:
        """The rows of each document and version of its highest batch, deletions included; within: the least and the largest id that matter; only: the documents and versions that do, if they are few."""
        rows = self._read("ledger", _LEDGER, entries)
        if within is not None:
            rows = rows.where(F.col("doc_id").between(*within))
        if only is not None:
            rows = rows.join(F.broadcast(only), ["doc_id", "version"], "left_semi")
        row = F.struct("batch", "source", "lang", "tokens", "live")
        return rows.groupBy("doc_id", "version").agg(F.max_by(row, "batch").alias("r")).select("doc_id", "version", "r.*")

    def ledger(self) -> DataFrame:
        """The rows in force: for each document and version the one of its highest batch, unless that deleted it."""
        return self._winners(self._log()[2]).where("live").drop("live", "batch")

    def commit(self, batch: int, events: DataFrame) -> bool:
        """Commit a batch of events (doc_id, op, source, lang, version, tokens, seq); False if its number is committed already."""
        last, known, entries = self._log()
        if batch in known:
            return False
        valid = events.where(F.col("op").isin(*OPERATIONS) & F.col("doc_id").isNotNull() & F.col("version").isNotNull())
        order = F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), "op", "source", "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"))
        new = valid.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version").agg(F.max(order).alias("e"))
        new = new.select("doc_id", "version", "e.source", "e.lang", F.col("e.tokens").cast("long").alias("tokens"), (F.col("e.op") != "delete").alias("live"), F.lit(batch).cast("long").alias("batch"))
        folder = f"{batch}-{uuid.uuid4().hex}"
        new.write.parquet(self._at("ledger", folder))
        written = self.spark.read.schema(_LEDGER).parquet(self._at("ledger", folder))
        *within, size = written.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
        ids = written.select("doc_id", "version")
        plus = [*KEYS, F.lit(1).cast("long").alias("docs"), "tokens"]
        minus = [*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens")]
        while True:
            signed = written.where("live").select(plus)
            if entries and within[0] is not None:
                old = self._winners(entries, within, ids) if size <= FEW_IDS else self._winners(entries, within).join(ids, ["doc_id", "version"], "left_semi")
                late = written.join(old.where(F.col("batch") > batch).select("doc_id", "version"), ["doc_id", "version"], "left_anti") if max(known) > batch else written
                signed = late.where("live").select(plus).union(old.where(F.col("live") & (F.col("batch") < batch)).select(minus))
            deltas = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            deltas.where("docs <> 0 OR tokens <> 0").write.mode("overwrite").parquet(self._at("deltas", folder))
            if self._append(last + 1, {"batch": batch, "folder": folder}):
                break
            last, known, entries = self._log()
            if batch in known:
                return False
        if len(entries) >= self.snapshot_every and self.snapshot():
            self.vacuum()
        return True

    def snapshot(self) -> bool:
        """Write ledger and totals up to now as tables of their own, from which reads begin; False if a commit came between."""
        last, known, entries = self._log()
        folder = f"upto-{last}-{uuid.uuid4().hex}"
        # By ranges of ids, so that a batch that touches some of them reads these only.
        self._winners(entries).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "version").write.parquet(self._at("ledger", folder))
        sums = self._read("deltas", _DELTAS, entries).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.where("docs <> 0 OR tokens <> 0").coalesce(1).write.parquet(self._at("deltas", folder))
        return self._append(last + 1, {"batches": known, "folder": folder})

    def vacuum(self, keep: int = 1, grace_seconds: int = GRACE_SECONDS) -> int:
        """Delete the tables that no reader starts from: those before the last snapshots (keep besides the newest), and those of attempts that were lost; the number of folders.

        Only what is older than grace_seconds goes, so that readers and commits that are under way keep what they have listed.
        """
        needed, snapshots = set(), 0
        for number in range(self._log()[0], 0, -1):
            entry = self._entry(number)
            needed.add(entry["folder"])
            snapshots += "batches" in entry
            if snapshots > keep:
                break
        gone, before = 0, int(time.time() * 1000) - grace_seconds * 1000
        for name in ("ledger", "deltas"):
            path = self._path(name)
            for f in self._fs.listStatus(path) if self._fs.exists(path) else []:
                if f.getPath().getName() not in needed and f.getModificationTime() <= before:
                    gone += bool(self._fs.delete(f.getPath(), True))
        return gone

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens): the sums of all deltas; keys that have no document any more are left out."""
        sums = self._read("deltas", _DELTAS, self._log()[2]).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0")

    def remove(self) -> None:
        """Delete the store."""
        self._fs.delete(self._path(""), True)


def piece_counts(docs: DataFrame, version: str = "piece-32k", model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insert events for documents (with source and lang) under a version that counts the pieces of a SentencePiece model, the end id included."""
    from .pieces import _chunks

    def make():
        chunks = _chunks(model)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = pa.array([len(ids) for ids in chunks.encode(texts(batch))], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), counts], names=["doc_id", "source", "lang", "tokens"])

        return apply

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).alias("text"))
    counted = map_text(narrow, "text", "doc_id long, source string, lang string, tokens long", make)
    return counted.select("doc_id", F.lit("insert").alias("op"), "source", "lang", F.lit(version).alias("version"), "tokens", F.lit(0).alias("seq"))


def words(text: str) -> Column:
    """Tokenizer version words-1: runs of anything but ASCII white space."""
    return F.size(F.regexp_extract_all(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)))


def words_and_marks(text: str) -> Column:
    """Tokenizer version marks-1: runs of letters and digits, and single other characters."""
    return F.size(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"), F.lit(0)))


def op2_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of the documents after four batches, one of which comes late and one twice.

    1: every document under words-1. 2: every document under marks-1. 3: the documents with a line
    that begins with "Licensed under" are revised under words-1, without such lines. 4: documents
    whose text an earlier document has are deleted under marks-1. Batch 1 comes after batch 3, and
    batch 3 is sent again. The totals, a row for each source, language and version, are checkpointed and the store removed.
    """
    ensure_checkpoint_dir(spark)
    bare = F.regexp_replace("text", r"(?m)^Licensed under[^\n]*", "")
    counted = (
        table(spark, sf_dir, "documents")
        .select(
            F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("copy"),
            F.coalesce(words("text"), F.lit(0)).alias("words"), F.coalesce(words_and_marks("text"), F.lit(0)).alias("marks"),
            F.when(F.col("text").rlike(r"(^|\n)Licensed under"), bare).alias("bare"),
        )
        .select("doc_id", "source", "lang", "copy", "words", "marks", words("bare").alias("bare_words"), F.col("bare").isNotNull().alias("revised"))
        .checkpoint()
    )

    def events(df: DataFrame, op: str, version: str, tokens: Column) -> DataFrame:
        return df.select("doc_id", F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), tokens.cast("long").alias("tokens"), F.lit(0).alias("seq"))

    first = counted.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).checkpoint()
    copies = join_sized(counted, first, "copy", "n", "doc_id").where("doc_id > first")
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    store = RollupStore(spark, posixpath.join(root, f"rollups-{uuid.uuid4().hex}"))
    revised = events(counted.where("revised"), "revise", "words-1", F.col("bare_words"))
    store.commit(2, events(counted, "insert", "marks-1", F.col("marks")))
    store.commit(3, revised)
    store.commit(1, events(counted, "insert", "words-1", F.col("words")))
    store.commit(4, events(copies, "delete", "marks-1", F.lit(0)))
    store.commit(3, revised)
    totals = store.totals().checkpoint()
    store.remove()
    return totals


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '(?m)^Licensed under[^\n]*', '', 'g') AS bare,
         row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS nth
  FROM documents
)
SELECT source, lang, 'words-1' AS version, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(bare, '[^ \t\n\x0B\f\r]+'))) AS BIGINT) AS n_tokens
FROM d GROUP BY source, lang
UNION ALL
SELECT source, lang, 'marks-1' AS version, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]'))) AS BIGINT) AS n_tokens
FROM d WHERE nth = 1 GROUP BY source, lang
"""
