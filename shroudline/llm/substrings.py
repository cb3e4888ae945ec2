"""Substring deduplication by content-defined chunks.

A gear hash rolls over the words of a text, eight at a time, and a chunk begins where it is the least
of eight neighbours. Where chunks begin depends on the fifteen words around only, so that an
insertion moves nothing else, and of any fifteen words in a row at least one place is a beginning: documents
that share these words share its digest. What they share around the place is told by the words
next to it, so that exactly the stretches of MIN_WORDS words are found that two documents hold.
Text without white space is cut into pieces of a word's length by a gear hash over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, ensure_checkpoint_dir, fresh, map_text, steps, table, texts

#: Bytes without white space from which on a text is cut between characters: at one in two beginnings of East Asian ones, one in six of others.
LONG_RUN, WIDE_ONE_IN, OTHER_ONE_IN = 32, 2, 6
#: Words that a repeated passage has at least.
MIN_WORDS = 15
#: Stands for a null id: documents without one come last.
NO_ID = 2**63 - 1
#: One in so many documents tells which digests are hot; a digest is not called hot for fewer occurrences there than HOT_LEAST.
HOT_ONE_IN, HOT_LEAST = 64, 8
#: Words whose hashes a task keeps.
WORDS_KEPT = 500_000

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 9) for b in range(256)], dtype=np.uint32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP, _LEFT, _RIGHT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + gear[byte] after each byte, over its last 32 bytes, by doubling the window five times."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h = more
    return h


def run_cuts(run: bytes) -> np.ndarray:
    """Where a run of bytes without white space is cut: at beginnings of characters that the lowest eight bits of the gear hash choose, which depend on the eight bytes before."""
    data = np.frombuffer(run, dtype=np.uint8)
    h, lead = gear_hashes(data)[:-1] & np.uint32(0xFF), data[1:]
    # Lead bytes from E3 on, but for the private and presentation forms of EE and EF, and those of four bytes.
    wide = (lead >= 0xE3) & (lead <= 0xED) | (lead >= 0xF0)
    return np.flatnonzero((lead & 0xC0 != 0x80) & (h < np.where(wide, 256 // WIDE_ONE_IN, 256 // OTHER_ONE_IN))) + 1


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text, in pieces where they are runs of over LONG_RUN bytes."""
    words = raw.split()
    if max(map(len, words), default=0) <= LONG_RUN:
        return words
    out = []
    for w in words:
        edges = [0, *run_cuts(w).tolist(), len(w)] if len(w) > LONG_RUN else [0, len(w)]
        out += [w[a:b] for a, b in zip(edges, edges[1:])]
    return out


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the words in bytes."""
    solid = ~_SPACE[np.frombuffer(raw, dtype=np.uint8)]
    turns = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = turns[::2], turns[1::2]
    more = [a + run_cuts(raw[a:b]) for a, b in zip(starts, ends) if b - a > LONG_RUN]
    if more:
        inner = np.concatenate(more)
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends


class _Hashes(dict):
    """Hashes of words, some of which are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53) ^ (x >> np.uint64(29))


def sizes(min_words: int) -> tuple[int, int, int]:
    """Words that the gear hash covers, neighbours it must be the least of, and words beside them to min_words."""
    k = (min_words + 1) // 2
    return k, min_words - k + 1, min_words - k


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    return np.minimum(x[: len(x) - (width - done)], x[width - done :])


def beginnings(h: np.ndarray, min_words: int, doc: np.ndarray | None = None) -> np.ndarray:
    """The places where chunks begin, given the hashes of the words (and the numbers of their documents): every min_words words in a row hold one whose gear hash they cover.

    The gear hash is (h << s) + gear[word], over as many words as have bits in it. Of equal hashes the last one counts.
    """
    k, among, side = sizes(min_words)
    m = len(h) - k + 1
    if m < among:
        return np.zeros(0, dtype=np.int64)
    gear, shift = (h >> np.uint64(32)).astype(np.uint32), -(-32 // k)
    rolled = np.zeros(m, dtype=np.uint32)
    for j in range(-(-32 // shift)):
        rolled += gear[k - 1 - j : k - 1 - j + m] << np.uint32(shift * j)
    rolled *= np.uint32(0x9E3779B1)
    rolled ^= rolled >> np.uint32(15)
    last = np.uint64(0xFFFFFFFF)
    least = _least_of((rolled.astype(np.uint64) << np.uint64(32)) | (last - np.arange(m, dtype=np.uint64)), among)
    if doc is not None:
        least = least[doc[: len(least)] == doc[min_words - 1 :]]
    begins = np.zeros(m, dtype=bool)
    begins[(last - (least & last)).astype(np.int64)] = True
    return np.flatnonzero(begins)


def packed(short: np.ndarray) -> np.ndarray:
    """Rows of an even number of 12-bit values as bytes."""
    a, b = short[:, ::2].astype(np.uint32), short[:, 1::2].astype(np.uint32)
    both = a | b << np.uint32(12)
    return np.stack([both, both >> np.uint32(8), both >> np.uint32(16)], axis=2).astype(np.uint8).reshape(len(short), -1)


def unpacked(raw: list[bytes], side: int) -> np.ndarray:
    """The same back: one row for each, the words to the left and those to the right."""
    x = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), side, 3).astype(np.uint32)
    both = x[:, :, 0] | x[:, :, 1] << np.uint32(8) | x[:, :, 2] << np.uint32(16)
    return np.stack([both & np.uint32(0xFFF), both >> np.uint32(12)], axis=2).reshape(len(raw), 2 * side)


def _own(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells documents apart: the id, NO_ID for null, and a hash of the text, which is 0 where every document has an id of its own."""
    doc_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    shared = docs.select(doc_id.alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).where(f"n > 1 OR doc_id = {NO_ID}")
    return doc_id, F.lit(0).cast("long") if shared.isEmpty() else F.xxhash64(text_col)


def _keys(digest: np.ndarray, beside: np.ndarray, side: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words to the left: which rows have these and the rest to the right, and a hash of such a stretch for all rows."""
    left, right = beside[:, :side].astype(np.uint64), beside[:, side:].astype(np.uint64)
    zero = np.zeros(len(digest), dtype=np.uint64)
    lefts, rights = [zero], [zero]
    for j in range(side):
        lefts.append((lefts[-1] + left[:, j] + np.uint64(1)) * _LEFT)
        rights.append((rights[-1] + right[:, j] + np.uint64(1)) * _RIGHT)
    base = _mixed(digest.view(np.uint64))
    for n in range(side + 1):
        there = np.ones(len(digest), dtype=bool)
        if n:
            there &= left[:, n - 1] > 0
        if n < side:
            there &= right[:, side - n - 1] > 0
        yield n, there, _mixed(base + _mixed(lefts[n]) + (_mixed(rights[side - n]) << np.uint64(1))).view(np.int64)


def _first(key: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row: whether several documents have its key, the smallest id among them, whether they all have it, and the smallest hash of texts then."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    back = np.empty(len(key), dtype=np.int64)
    back[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(key)))
    least, most = (f.reduceat(doc[order], starts) for f in (np.minimum, np.maximum))
    low, high = (f.reduceat(h[order], starts) for f in (np.minimum, np.maximum))
    one = least == most
    return (~one | (low < high))[back], least[back], one[back], low[back]


class _Found:
    """What is known of m chunks with each number of words to the left: whether the stretch is shared, and its first document."""

    def __init__(self, m: int, side: int):
        shape = (m, side + 3)  # a column more on either side
        self.shared, self.alone = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
        self.first, self.text = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)

    def put(self, rows: np.ndarray, left: int, shared: np.ndarray, least: np.ndarray, one: np.ndarray, low: np.ndarray) -> None:
        self.shared[rows, left + 1], self.first[rows, left + 1], self.alone[rows, left + 1], self.text[rows, left + 1] = shared, least, one, np.where(one, low, 0)

    def spans(self, at: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
        """(row, a, b, first_doc, first_h, whether there is a first_h): neighbouring stretches of one first document are put together."""
        pair = lambda x: x[:, 1:] == x[:, :-1]
        joined = self.shared[:, 1:] & self.shared[:, :-1] & pair(self.first) & pair(self.alone) & pair(self.text)
        r, low = np.nonzero(self.shared[:, 1:] & ~joined)
        _, high = np.nonzero(self.shared[:, :-1] & ~joined)  # the last column of a run is followed by one that isn't joined to it
        column = low + 1
        return r, at[r] - (high - 1), at[r] + min_words - low, self.first[r, column], self.text[r, column], self.alone[r, column]


class Hot:
    """Digests that very many chunks have; and the stretches about them that very many hold, with what is known of them.

    Both are bounded: each has more than a given share of all chunks.
    """

    def __init__(self, digests: list[int], stretches: list[tuple[int, int, int, int, int]] = ()):
        self.digests = np.array(sorted(digests), dtype=np.int64)
        rows = np.array(sorted(stretches), dtype=np.int64).reshape(-1, 5)
        self.keys, self.low, self.high, self.low_h, self.high_h = rows.T

    def place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys are, and which of them are."""
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), dtype=bool)


class _Step:
    """The chunks of the texts of one step."""

    def __init__(self, batch: pa.RecordBatch, min_words: int, known: _Hashes, powers: np.ndarray):
        k, _, side = sizes(min_words)
        words = [words_of(raw or b"") for raw in batch.column("text").to_pylist()]
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        h = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=counts.sum())
        doc, ends = np.repeat(np.arange(len(words)), counts), counts.cumsum()
        at = beginnings(h, min_words, doc)
        self.digest = _mixed((h[at[:, None] + np.arange(k)] * powers).sum(axis=1, dtype=np.uint64)).view(np.int64)
        own = doc[at]
        first, end = (ends - counts)[own], ends[own]
        # Zero stands for a word that isn't there.
        short = np.maximum((h >> np.uint64(8)).astype(np.uint16) & np.uint16(0xFFF), 1)
        places = np.concatenate([at[:, None] - 1 - np.arange(side), at[:, None] + k + np.arange(side)], axis=1)
        there = (places >= first[:, None]) & (places < end[:, None])
        self.beside = np.where(there, short[np.where(there, places, 0)], 0) if len(at) else np.zeros((0, 2 * side), dtype=np.uint16)
        self.at = (at - first).astype(np.int64)
        self.doc_id, self.h = (batch.column(c).to_numpy()[own] for c in ("doc_id", "h"))


def _stepper(min_words: int):
    k = sizes(min_words)[0]
    known, powers = _Hashes(), np.array([pow(int(_STEP), j, 1 << 64) for j in range(k)], dtype=np.uint64)
    return lambda batch: _Step(batch, min_words, known, powers)


CHUNKS = "digest long, doc_id long, h long, at int, beside binary, b int, first_doc long, first_h long"


def chunks(docs: DataFrame, min_words: int, hot: Hot | None = None) -> DataFrame:
    """(digest, doc_id, h, at, beside, b, first_doc, first_h) of documents (doc_id, h, text).

    A chunk has the digest of its first words, the number of words before, and hashes of the words to the left and right (beside).
    Those with a hot digest give their stretches instead: one that is hot is known already, so that its span
    from at to b has its first document, and a digest that only spreads it; any other has
    its own hash for a digest and no words beside, so that it meets its like.
    """
    side = sizes(min_words)[2]

    def make():
        step_of = _stepper(min_words)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = step_of(batch)
            heated = np.isin(x.digest, hot.digests) if hot else np.zeros(len(x.at), dtype=bool)
            plain, i = np.flatnonzero(~heated), np.flatnonzero(heated)
            parts = [(x.digest[plain], x.doc_id[plain], x.h[plain], x.at[plain])]
            done: tuple = ()
            if len(i):
                found = _Found(len(i), side)
                for left, there, key in _keys(x.digest[i], x.beside[i], side):
                    rows = np.flatnonzero(there)
                    place, known = hot.place(key[rows])
                    place = place[known]
                    one = hot.low[place] == hot.high[place]
                    found.put(rows[known], left, ~one | (hot.low_h[place] < hot.high_h[place]), hot.low[place], one, hot.low_h[place])
                    rest = rows[~known]
                    parts.append((key[rest], x.doc_id[i[rest]], x.h[i[rest]], x.at[i[rest]] - left))
                r, a, b, first, text, alone = found.spans(x.at[i], min_words)
                done = (b, first, text, alone)
                parts.append((_mixed((x.doc_id[i[r]] * 1_000_003 + a).view(np.uint64)).view(np.int64), x.doc_id[i[r]], x.h[i[r]], a))
            digest, doc_id, h, at = (np.concatenate(c) for c in zip(*parts))
            n, m, z = len(digest), len(plain), len(done[0]) if done else 0
            lengths = np.zeros(n, dtype=np.int64)
            lengths[:m] = 3 * side
            offsets = pa.py_buffer(np.concatenate([[0], lengths.cumsum()]).astype(np.int32).tobytes())
            chunk = np.arange(n) < m
            beside = pa.Array.from_buffers(pa.binary(), n, [pa.py_buffer(np.packbits(chunk, bitorder="little").tobytes()), offsets, pa.py_buffer(packed(x.beside[plain]).tobytes() if m and side else b"")])
            tail = lambda values, kind, known=None: pa.array(np.concatenate([np.zeros(n - z, dtype=kind), np.asarray(values, dtype=kind)]), mask=np.concatenate([np.ones(n - z, dtype=bool), ~known if known is not None else np.zeros(z, dtype=bool)]))
            b, first, text, alone = done or ([], [], [], np.zeros(0, dtype=bool))
            return pa.RecordBatch.from_arrays([pa.array(digest), pa.array(doc_id), pa.array(h), pa.array(at.astype(np.int32)), beside, tail(b, np.int32), tail(first, np.int64), tail(text, np.int64, alone)], names=[c.split()[0] for c in CHUNKS.split(", ")])

        return apply

    return map_text(docs, "text", CHUNKS, make)


SPANS = "doc_id long, h long, a int, b int, first_doc long, first_h long"


def _span_batch(doc, h, a, b, first, text, alone) -> pa.RecordBatch:
    arrays = [pa.array(doc), pa.array(h), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(first), pa.array(text, mask=~alone)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SPANS.split(", ")])


def _spans_of(batch: pa.RecordBatch, min_words: int) -> Iterator[pa.RecordBatch]:
    """The spans of chunks and stretches that several documents share, all rows of a digest being there; spans that are known go through."""
    side = sizes(min_words)[2]
    known = batch.column("first_doc").is_valid().to_numpy(zero_copy_only=False)
    if known.any():
        kept = batch.filter(pa.array(known))
        yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("doc_id", "h", "at", "b", "first_doc", "first_h")], names=[c.split()[0] for c in SPANS.split(", ")])
        batch = batch.filter(pa.array(~known))
    if not batch.num_rows:
        return
    digest = batch.column("digest").to_numpy()
    same = np.diff(digest, append=~digest[-1:]) == 0
    rows = np.flatnonzero(same | np.concatenate([[False], same[:-1]]))
    if not len(rows):
        return
    batch = batch.take(pa.array(rows))
    whole = batch.column("beside").is_valid().to_numpy(zero_copy_only=False)
    columns = [batch.column(c).to_numpy() for c in ("digest", "doc_id", "h", "at")]
    digest, doc, h, at = (c[~whole] for c in columns)
    if len(digest):  # stretches of hot digests
        shared, least, one, low = _first(digest, doc, h)
        yield _span_batch(doc[shared], h[shared], at[shared], at[shared] + min_words, least[shared], np.where(one, low, 0)[shared], one[shared])
    digest, doc, h, at = (c[whole] for c in columns)
    if len(digest):
        found = _Found(len(digest), side)
        for left, there, key in _keys(digest, unpacked(batch.column("beside").filter(pa.array(whole)).to_pylist(), side), side):
            i = np.flatnonzero(there)
            if len(i):
                found.put(i, left, *_first(key[i], doc[i], h[i]))
        r, a, b, first, text, alone = found.spans(at, min_words)
        yield _span_batch(doc[r], h[r], a, b, first, text, alone)


def _shared_spans(rows: DataFrame, min_words: int) -> DataFrame:
    """The spans of chunks: one shuffle by digest, and one pass over the sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            digest = batch.column("digest").to_numpy()
            # The rows of the last digest wait for the next batch.
            cut = int(np.searchsorted(digest, digest[-1]))
            if cut == 0 and held and held[0].column("digest")[0].as_py() != digest[0]:
                yield from _spans_of(whole(held), min_words)
                held = []
            if cut:
                yield from _spans_of(whole([*held, batch.slice(0, cut)]), min_words)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from _spans_of(whole(held), min_words)

    return rows.repartition("digest").sortWithinPartitions("digest").mapInArrow(run, SPANS)


def _stretch_keys(rows: DataFrame, min_words: int) -> DataFrame:
    """(key) of the stretches about each chunk."""
    side = sizes(min_words)[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beside = unpacked(batch.column("beside").to_pylist(), side)
            for _, there, key in _keys(batch.column("digest").to_numpy(), beside, side):
                yield pa.RecordBatch.from_arrays([pa.array(key[there])], names=["key"])

    return rows.select("digest", "beside").mapInArrow(run, "key long")


def _ends(docs: DataFrame, min_words: int, digests: list[int], keys: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(key, low, high, low_h, high_h): the least and greatest ids and hashes of texts of all documents that hold each of a few stretches. A task gives a row for a key at most."""
    hot, side = Hot(digests, [(k, 0, 0, 0, 0) for k in keys]), sizes(min_words)[2]
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step_of = _stepper(min_words)
        ends = [np.full(len(hot.keys), x) for x in (most, least, most, least)]
        for batch in steps(batches, "text"):
            x = step_of(batch)
            i = np.flatnonzero(np.isin(x.digest, hot.digests))
            for _, there, key in _keys(x.digest[i], x.beside[i], side):
                rows = np.flatnonzero(there)
                place, known = hot.place(key[rows])
                rows, place = i[rows[known]], place[known]
                for end, put, values in zip(ends, (np.minimum, np.maximum) * 2, (x.doc_id, x.doc_id, x.h, x.h)):
                    put.at(end, place, values[rows])
        seen = ends[0] <= ends[1]
        yield pa.RecordBatch.from_arrays([pa.array(c[seen]) for c in (hot.keys, *ends)], names=["key", "low", "high", "low_h", "high_h"])

    rows = docs.mapInArrow(run, "key long, low long, high long, low_h long, high_h long")
    found = rows.groupBy("key").agg(F.min("low"), F.max("high"), F.min("low_h"), F.max("high_h")).collect()  # as many as there are keys
    return [tuple(r) for r in found]


def heat(docs: DataFrame, min_words: int) -> Hot | None:
    """Digests and stretches that more than HOT_SHARE of all chunks have, or half of an average task's share, as one document in HOT_ONE_IN tells.

    There are fewer than 2,000 such digests, or twice the shuffle partitions, and fewer than that times the words beside a
    chunk and one of stretches. Only the way of the work depends on them, not its result.
    """
    some = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(HOT_ONE_IN)) == 0)
    rows = chunks(some, min_words).select("digest", "beside").checkpoint()
    total = rows.count()
    least = max(HOT_LEAST, total * min(HOT_SHARE, 0.5 / int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    digests = [r["digest"] for r in rows.groupBy("digest").count().where(F.col("count") > least).collect()]
    if not digests:
        return None
    hot = docs.sparkSession.createDataFrame([(d,) for d in digests], "digest long")
    about = _stretch_keys(rows.join(F.broadcast(hot), "digest", "left_semi"), min_words)
    keys = [r["key"] for r in about.groupBy("key").count().where(F.col("count") > least).collect()]
    return Hot(digests, _ends(docs, min_words, digests, keys) if keys else [])


def repeated_stretches(docs: DataFrame, own: tuple[Column, Column], text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, a, b, first_doc, first_h): words a to b of a document, of which another one holds each min_words in a row. own tells documents apart.

    first_doc is the smallest id that has them, first_h the smallest hash of the texts that have them if they all have that id.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    narrow = docs.select(own[0].alias("doc_id"), own[1].alias("h"), F.col(text_col).cast("binary").alias("text"))
    return _shared_spans(chunks(narrow, min_words, heat(narrow, min_words)), min_words)


def _passages(docs: DataFrame, own: tuple[Column, Column], text_col: str, min_words: int) -> DataFrame:
    """passages in words, with doc_id and h as chunks has them."""
    # One shuffle by document serves all that follows.
    rows = repeated_stretches(docs, own, text_col, min_words).repartition("doc_id", "h").dropDuplicates(["doc_id", "h", "a", "b", "first_doc"])
    doc = ["doc_id", "h"]
    in_doc = Window.partitionBy(doc).orderBy("a", "b")
    so_far, earlier = in_doc.rowsBetween(Window.unboundedPreceding, 0), in_doc.rowsBetween(Window.unboundedPreceding, -1)
    cut = (F.col("first_doc") < F.col("doc_id")) | F.coalesce(F.col("first_h") < F.col("h"), F.lit(False))
    rows = rows.select(
        *doc, "a", "b",
        F.when(cut, F.col("first_doc")).alias("first_doc"),
        F.lead("a").over(in_doc).alias("next"),
        F.max("b").over(so_far).alias("covered"),
        F.max("b").over(earlier).alias("reached"),
        F.max(F.when(cut, F.col("b"))).over(so_far).alias("cuttable"),
    )
    rows = rows.withColumn("run", F.sum(F.when(F.col("a") < F.col("reached"), 0).otherwise(1)).over(so_far))
    # From the start of a row to that of the next one: first what can go, then what only this or later documents cover.
    gone_to = F.least(F.greatest("a", "cuttable"), F.coalesce("next", "covered"))
    kept_to = F.least("covered", F.coalesce("next", "covered"))
    piece = lambda a, b, removable, first: F.struct(a.alias("a"), b.alias("b"), F.lit(removable).alias("removable"), first.alias("first_doc"))
    pieces = F.array(piece(F.col("a"), gone_to, True, F.col("first_doc")), piece(gone_to, kept_to, False, F.col("doc_id")))
    parts = rows.select(*doc, "run", F.explode(pieces).alias("p")).select(*doc, "run", "p.*").where("a < b")
    in_run = Window.partitionBy(doc).orderBy("a")
    turn = (F.lag("run").over(in_run) != F.col("run")) | (F.lag("removable").over(in_run) != F.col("removable"))
    return (
        parts.withColumn("part", F.sum(F.when(turn, 1).otherwise(0)).over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*doc, "run", "removable", "part")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("first_doc").alias("first_doc"))
        .select(*doc, "run", "a", "b", "first_doc", "removable")
    )


def _located(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """_passages with their places in bytes: (doc_id, h, spans), one row a document, spans in order."""
    own = _own(docs, id_col, text_col)
    found = _passages(docs, own, text_col, min_words)
    span = F.struct("a", "b", "run", "removable", "first_doc")
    per = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    joined = docs.select(own[0].alias("doc_id"), own[1].alias("h"), F.col(text_col).alias("text")).join(per, ["doc_id", "h"])

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            places = []
            for text, spans in zip(texts(batch), batch.column("spans").to_pylist()):
                starts, ends = word_bounds(text.encode("utf-8", "surrogatepass"))
                places.append([{**{k: s[k] for k in ("run", "removable", "first_doc")}, "start": int(starts[s["a"]]), "end": int(ends[s["b"] - 1]), "words": s["b"] - s["a"]} for s in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("run", pa.int64()), ("removable", pa.bool_()), ("first_doc", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(places, kind)], names=["doc_id", "h", "spans"])

        return apply

    spans = "array<struct<start:bigint,end:bigint,words:bigint,run:bigint,removable:boolean,first_doc:bigint>>"
    return map_text(joined, "text", f"doc_id long, h long, spans {spans}", make).dropDuplicates(["doc_id", "h"])


def _null_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("doc_id", "first_doc")})


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, run, start, end, words, first_doc, removable): the repeated passages, as byte ranges; h tells texts apart that share an id, and is 0 where none do.

    A passage is what overlapping stretches of min_words words cover, each of which one other document holds
    in a row; all such stretches are found. It gives one row for each part that stretches of an earlier
    document, which keeps them, cover or don't cover (removable).
    Cases: a null text has no passage; texts of any length are read whole; repetitions inside one
    document alone are none of this operator's business; repeated rows with one id and text
    count as one document, different texts under one id or none as several. Documents come in the
    order of their ids, those without one last, and texts of one id by their hashes; where the first id
    has several texts with a passage and a later id has it too, all texts of the first id keep it.
    Extra columns are not looked at; an empty table gives no rows.
    """
    rows = _located(docs, id_col, text_col, min_words).select("doc_id", "h", F.inline("spans"))
    return _null_ids(rows.select("doc_id", "h", "run", "start", "end", "words", "first_doc", "removable"))


def shared_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each document with a repeated passage: how many, how long, which can go, and where they are, in words from 0 (a:b, b not included)."""
    found = _passages(docs, _own(docs, id_col, text_col), text_col, min_words)
    spans = F.array_sort(F.collect_list(F.struct("a", "b", "removable")))
    gone = F.filter("spans", lambda s: s["removable"])
    places = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["a"], s["b"])), ",")
    words = (F.col("b") - F.col("a")).cast("long")
    rows = found.groupBy("doc_id", "h").agg(
        F.min("first_doc").alias("first_doc"), F.count_distinct("run").alias("n_passages"), F.sum(words).alias("repeated_words"), F.sum(F.when(F.col("removable"), words).otherwise(0)).alias("removed_words"), spans.alias("spans"),
    )
    return _null_ids(rows.select("doc_id", "first_doc", "n_passages", "repeated_words", "removed_words", places(F.col("spans")).alias("passages"), places(gone).alias("removed")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the removable passages cut out of the texts; all rows and columns stay. A null text stays null."""
    key, h, cuts = fresh("key", docs), fresh("h", docs), fresh("cuts", docs)
    own = _own(docs, id_col, text_col)
    gone = _passages(docs, own, text_col, min_words).where("removable")
    cut = gone.groupBy(F.col("doc_id").alias(key), F.col("h").alias(h)).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias(cuts))
    joined = docs.withColumns({key: own[0], h: own[1]}).join(cut, [key, h], "left").select(*docs.columns, cuts)
    at = docs.columns.index(text_col)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(cuts).to_pylist()):
                if spans:
                    raw, kept, last = text.encode("utf-8", "surrogatepass"), [], 0
                    starts, ends = word_bounds(raw)
                    for s in spans:
                        kept.append(raw[last : starts[s["a"]]])
                        last = max(last, ends[s["b"] - 1])
                    kept.append(raw[last:])
                    text = b"".join(kept).decode("utf-8", "surrogatepass")
                out.append(text)
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

        return apply

    return map_text(joined, text_col, docs.schema, make)


def op9_substrings(spark, sf_dir):
    """Documents with passages that other documents have too."""
    return shared_documents(table(spark, sf_dir, "documents"))
