"""SimHash near-duplicate groups through a byte-position inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, fresh, join_sized, map_text, table, texts
from .components import components

#: Fingerprints link at this many differing bits at most.
MAX_BITS = 3
#: Of eight byte positions at least this many agree when at most MAX_BITS bits differ.
MIN_BYTES = 8 - MAX_BITS
#: A posting list longer than this is split on further bits.
LONG_LIST = 1024
_SEED = 42


def fingerprint(text: str, k: int = 3) -> int:
    """64-bit SimHash of the k-word shingles (repeats count); words are runs of anything but ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= k:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), _SEED)], dtype=np.uint64)
    else:
        joined, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[:-1]]]
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(starts, ends[k - 1 :])), dtype=np.uint64, count=len(words) - k + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp long, h long): one row for each input row; h is a hash of the text. A null or wordless text has fingerprint zero."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t, k) for t in texts(batch)], dtype=np.uint64).astype(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp), batch.column("h")], names=["doc_id", "fp", "h"])

        return apply

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return map_text(narrow, "text", "doc_id long, fp long, h long", make)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_masks() -> list[int]:
    """Masks of three byte positions such that any MIN_BYTES = 5 of the 8 positions contain one of them.

    The positions are dealt into two halves of four; five positions put three into one half.
    """
    from itertools import combinations

    return [sum(0xFF << (8 * p) for p in three) for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for three in combinations(half, 3)]


def finer_masks(mask: int) -> list[int]:
    """The mask with one more block of bits, for each of MAX_BITS + 1 blocks of the free bits: one block is always equal."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in block.tolist()) for block in np.array_split(np.array(free), MAX_BITS + 1)]


def list_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in one posting list of distinct fingerprints.

    Shared positional bytes are tallied for the pairs, pairs under MIN_BYTES are dropped,
    and the rest are verified by their differing bits.
    """
    n, out = len(fps), []
    if n < 2:
        return out
    by_byte, label = fps.view(np.uint8).reshape(n, 8), np.arange(n)
    for i in range(n - 1):
        tally = (by_byte[i + 1 :] == by_byte[i]).sum(axis=1)
        near = i + 1 + np.flatnonzero(tally >= MIN_BYTES)
        if len(near):
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= MAX_BITS]
            new, first = np.unique(label[near], return_index=True)
            for lab, j in zip(new.tolist(), near[first].tolist()):
                if lab != label[i]:
                    out.append((i, j))
                    label[label == lab] = label[i]
    return out


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect the same fingerprints as all links would.

    The inverted index is keyed by the values at three byte positions at once; two fingerprints
    with five equal bytes meet in at least one of its eight lists. Lists of more than LONG_LIST
    entries are keyed anew with one more of four blocks of the free bits, which again every
    linked pair shares once; at the last level 14 bits at most are free, so a list has at most
    16,384 entries whatever the data. Every list is thus bounded, no pair is lost, and a list of
    n entries gives n - 1 links at most.
    """
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    masks, level = first_masks(), 0
    rows = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found: list[DataFrame] = []

    def make_lists(batches):
        for batch in batches:
            a, b = [], []
            for fps in batch.column("fps").to_pylist():
                x = np.array(sorted(fps), dtype=np.int64).view(np.uint64)
                for i, j in list_links(x):
                    a.append(int(x[i].astype(np.int64)))
                    b.append(int(x[j].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    while True:
        keyed = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        last = max(64 - m.bit_count() for m in masks) <= 14
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
        short = sizes if last else sizes.where(F.col("n") <= LONG_LIST)
        lists = keyed.join(short, ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(lists.select("fps").mapInArrow(make_lists, "a long, b long"))
        if last or sizes.where(F.col("n") > LONG_LIST).isEmpty():
            break
        finer = [(m, f) for m in masks for f in finer_masks(m)]
        # A fixed set of 32 to 2,048 pairs of masks, whatever the data.
        pairs = F.broadcast(spark.createDataFrame([(_signed(m), _signed(f)) for m, f in finer], "mask long, finer long"))
        rows = keyed.join(sizes.where(F.col("n") > LONG_LIST), ["mask", "key"]).join(pairs, "mask").select("fp", F.col("finer").alias("mask")).distinct()
        masks, level = sorted({f for _, f in finer}), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _groups(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, fp, h), and the nodes (fp, n, rep, first): each fingerprint with the number of its rows,
    the smallest id of its group, and the group's first row as (no_id, doc_id, h). Both are checkpoints.

    Exact copies are one node (an aggregate that is combined on the map side), so that their number
    never matters for the index or the links.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col, k).checkpoint()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    nodes = rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(place).alias("own")).checkpoint()
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).checkpoint()
    firsts = rooted.groupBy("root").agg(F.count("*").alias("size"), F.min("own").alias("first")).checkpoint()
    return rows, join_sized(rooted, firsts, "root", "size", "fp").select("fp", "n", F.col("first.doc_id").alias("rep"), "first").checkpoint()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): each row's near-duplicate group, named by its smallest id.

    Cases: a null text counts as empty; empty texts share fingerprint zero and link like any other;
    texts of any length are read whole; repeated rows stay separate rows of the same group; a row
    with a null id gets the group of its fingerprint (null if no row of the group has an id);
    columns other than the id and the text are not looked at; an empty table gives no rows.

    A fingerprint that a large share of all rows has is joined by broadcast (join_sized).
    """
    rows, nodes = _groups(docs, id_col, text_col, k)
    named = join_sized(rows.select("doc_id", "fp"), nodes.select("fp", "n", "rep"), "fp", "n", "doc_id")
    return named.select("doc_id", "fp", F.col("rep").alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """The rows of ``docs``, columns unchanged, of which one row of each near-duplicate group stays: the first one.

    Rows come in the order of their ids, those without one last, and rows of one id by a hash of
    their texts; of rows with the same id and text any one counts. So texts in different groups
    all stay, also under one id or none.
    """
    _, nodes = _groups(docs, id_col, text_col, k)
    none, key, h, row = (fresh(c, docs) for c in ("none", "key", "h", "row"))
    # Without nulls, so that one shuffle serves the choice among rows with the same id and text, which every task makes before it, and the join.
    own = {none: F.col(id_col).isNull(), key: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), h: F.xxhash64(text_col)}
    once = docs.withColumns(own).groupBy(none, key, h).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias(row))
    first = nodes.select(F.col("first.no_id").alias(none), F.coalesce("first.doc_id", F.lit(0)).alias(key), F.col("first.h").alias(h)).distinct()
    return once.join(first, [none, key, h], "left_semi").select(*[F.col(row)[c].alias(c) for c in docs.columns])


def op7_simhash(spark, sf_dir):
    """Near-duplicate groups of all documents: doc_id, fingerprint, component_id."""
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
