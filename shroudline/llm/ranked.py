"""Ranked lexical search: documents are scored window by window.

Every task is a segment. Its documents are numbered in the order of their ids, and the postings of
a fixed window of these numbers are traversed term by term: what a posting adds goes into an array
of one window, an occupancy bitset tells which places were hit, and those are harvested into a heap
for each query. The postings hold the terms of the queries only and never leave their task.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, map_text, table

#: Documents of a window: its array of scores has 32 kB and stays in a core's cache.
WINDOW = 4096
#: Queries, and terms in them, that one pass over the documents answers at most; more are answered by further passes.
BLOCK_ITEMS, BLOCK_TERMS = 20_000, 1_000_000
#: Parameters of the score. Fixed values.
TF_SCALE, LENGTH_SHARE, SATURATION = 1_000_000_000, 75, 8

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(raw: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and any character beyond ASCII, A-Z lower-cased; null has none."""
    return _TERM.findall(raw.lower()) if raw else []


def weight(n_docs: int, df: int) -> int:
    """The weight of a term that df of n_docs documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def blocks(items: Iterable, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple]]:
    """Queries (id, counts of terms) in blocks of a bounded size."""
    block, size = [], 0
    for row in items:
        counts = Counter(terms(None if row[1] is None else bytes(row[1])))
        if block and (len(block) >= block_items or size + len(counts) > block_terms):
            yield block
            block, size = [], 0
        block.append((row[0], counts))
        size += len(counts)
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and how often it holds those of the vocabulary (by index).

    The documents of a task are sorted by their ids, those without one last.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded by BLOCK_TERMS

    def make():
        index = {t: i for i, t in enumerate(shared.value)}

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ends, which, tfs = [], [0], [], []
            for raw in batch.column("text").to_pylist():
                counts = Counter(terms(raw))
                n.append(counts.total())
                for t in counts.keys() & index.keys():
                    which.append(index[t])
                    tfs.append(counts[t])
                ends.append(len(which))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (which, tfs)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

        return apply

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = map_text(narrow, "text", "doc_id long, n long, terms array<int>, tfs array<int>", make)
    return rows.sortWithinPartitions(F.col("doc_id").asc_nulls_last())


class Segment:
    """The scores of a task's documents for all queries of a block, fed by windows in the order of the ids."""

    def __init__(self, queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.queries, self.weights, self.n_docs, self.n_terms, self.k = queries, weights, n_docs, n_terms, k
        self.heaps: list[list[tuple]] = [[] for _ in queries]
        self.seen = 0
        self.scores = np.zeros(WINDOW, dtype=np.int64)

    def add(self, ids: list, n: list[int], ends: np.ndarray, which: np.ndarray, tfs: np.ndarray) -> None:
        """A window: ids and lengths of its documents, and their postings; ends are the offsets of the documents in them."""
        m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * x * self.n_docs // self.n_terms if x else 0 for x in n], dtype=np.int64)
        place, tf = np.repeat(np.arange(len(ids)), np.diff(ends)), tfs.astype(np.int64)
        add = self.weights[which] * ((TF_SCALE * tf) // (1000 * tf + SATURATION * m[place]))
        order = np.argsort(which, kind="stable")
        which, place, add = which[order], place[order], add[order]
        starts = np.flatnonzero(np.diff(which, prepend=-1))
        lists = {int(which[a]): (place[a:b], add[a:b]) for a, b in zip(starts, [*starts[1:], len(which)])}
        hit, bits = np.zeros(WINDOW, dtype=bool), {}
        for t, (at, _) in lists.items():
            hit[at] = True
            bits[t] = np.packbits(hit)
            hit[at] = False
        for heap, query in zip(self.heaps, self.queries):
            occupied = None
            for t, times in query:
                if t in lists:
                    at, x = lists[t]
                    self.scores[at] += x if times == 1 else times * x  # a document is in a list once
                    occupied = bits[t].copy() if occupied is None else np.bitwise_or(occupied, bits[t], out=occupied)
            if occupied is not None:
                self._harvest(heap, np.flatnonzero(np.unpackbits(occupied)), ids)
        self.seen += len(ids)

    def _harvest(self, heap: list[tuple], at: np.ndarray, ids: list) -> None:
        """Take the occupied places into the heap and clear them; a document that comes later gives way to one of the same score."""
        scores = self.scores[at]
        self.scores[at] = 0
        better = scores > (heap[0][0] if len(heap) == self.k else 0)
        at, scores = at[better], scores[better]
        best = np.argsort(-scores, kind="stable")[: self.k]
        for place, score in zip(at[best].tolist(), scores[best].tolist()):
            entry = (score, -(self.seen + place), ids[place])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif score > heap[0][0]:
                heapq.heapreplace(heap, entry)


def _score(rows: DataFrame, queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best of every task."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(*shared.value, n_docs, n_terms, k)
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = [t.column(c).combine_chunks() for c in ("terms", "tfs")]
            lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
            ends = lists[0].offsets.to_numpy()
            segment.add(t.column("doc_id").to_pylist(), t.column("n").to_pylist(), ends - ends[0], *[x.flatten().to_numpy() for x in lists])
            held.clear()

        room = WINDOW
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, room)
                held.append(part)
                at, room = at + part.num_rows, room - part.num_rows
                if not room:
                    flush()
                    room = WINDOW
        if held:
            flush()
        found = [(i, doc_id, score) for i, heap in enumerate(segment.heaps) for score, _, doc_id in heap]
        for a in range(0, len(found), 10_000):
            item, doc_id, score = zip(*found[a : a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of items, by term weights that are saturated and normalised by length.

    Queries are taken in blocks of a bounded size; each block is one pass over whole texts, which gives
    the statistics and the postings of the block's terms, and one over these postings. The statistics
    (documents with a term, all terms, documents of each term) count all documents.
    Cases: null and empty texts have no terms and are no documents of the statistics; a query without terms,
    or whose terms no document has, has no rows; every row of items is a query of its own, also under a null id
    or one that others have; every row of docs is a document of its own: one without an id comes last
    among equal scores; terms that a query repeats count as often; extra columns are not looked at; empty
    tables give no rows.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    found = []
    asked = items.select(F.col(item_col).alias("id"), F.col(query_col).cast("binary").alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    for block in blocks(asked.toLocalIterator(), block_items, block_terms):
        vocabulary = sorted({t for _, counts in block for t in counts})
        index = {t: i for i, t in enumerate(vocabulary)}
        rows = postings(docs, vocabulary, id_col, text_col).checkpoint()
        total = rows.agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["terms"]:
            continue
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # as many as the block has terms
            weights[r["t"]] = weight(total["docs"], r["df"])
        queries = [[(index[t], times) for t, times in counts.items()] for _, counts in block]
        best = _score(rows, queries, weights, total["docs"], total["terms"], k)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = F.broadcast(spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, id {kind}"))  # a block
        found.append(ranked.join(ids, "item").select(F.col("id").alias(item_col), "rank", "doc_id", "score").checkpoint())
    if not found:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.union, found)


def op11_ranked(spark, sf_dir):
    """The ten best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_SPLIT} AS words FROM documents),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM docs WHERE len(words) > 0),
postings AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(words) AS term FROM docs) GROUP BY d, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total
),
lengths AS (SELECT d, doc_id, 100 - 75 + ((75 * len(words) * n_docs) // n_terms) AS m FROM docs, total WHERE len(words) > 0),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark) GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (d)
  GROUP BY item_id, d, doc_id
),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
