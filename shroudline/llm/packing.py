"""Hierarchical packing of tokenized documents into windows of several lengths."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, table

#: Window lengths, powers of two, longest first.
TIERS = (4096, 2048, 1024, 512)
#: Tokens that a task gathers before it packs them.
BUFFER_TOKENS = 2_000_000
#: Tokens of a step group; its sequences have one length, so that its cost is the same as that of any other group of the tier.
GROUP_TOKENS = 65_536
END_ID = 2
#: Entries of a worker's table of encoded runs, and characters of a run that is kept in it.
TABLE_RUNS, TABLE_RUN_CHARS = 500_000, 64


#: A word that is a run of Latin letters, which normalisation leaves alone, with a run of ASCII punctuation behind it; an apostrophe may begin a contraction, "<" a special token.
_SIMPLE = "^(?P<letters>[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)(?P<marks>[!-&(-/:;=-@\\[-`{-~]*)$"


class Runs:
    """Ids of runs of letters and of punctuation, as little-endian unsigned 32-bit integers, in a bounded table.

    The tokenizer lower-cases, splits into runs of letters, single digits and runs of other
    characters, and merges within those. The merges get many new runs as one text; their ends are
    found by the pieces that end a word. Words of another form go through the tokenizer one by one.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends_word = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        self.ends_word[[i for piece, i in self.whole.get_vocab().items() if piece.endswith("</w>")]] = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_chars = dict(zip(shown, map(chr, shown))) | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {"": b""}

    def _as_bytes(self, run: str) -> str:
        return run if run.isascii() else "".join(map(self.byte_chars.__getitem__, run.encode()))

    def lookup(self, runs: list[str]) -> list[bytes]:
        """The ids of each of some distinct lower-case runs; those that are not too long are kept."""
        if len(self.known) + len(runs) > TABLE_RUNS:
            self.known = {"": b""}
        found = list(map(self.known.get, runs))
        new = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            text = " ".join([self._as_bytes(runs[i]) for i in part])
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(ends) != len(part):
                raise RuntimeError("the pieces that end words don't part the runs")
            raw, start = ids.tobytes(), 0
            for i, end in zip(part, ends.tolist()):
                found[i] = raw[start:end]
                if len(runs[i]) <= TABLE_RUN_CHARS:
                    self.known[runs[i]] = found[i]
                start = end
        return found

    def others(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]


_runs = lru_cache(maxsize=2)(Runs)


def _numbered(runs: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = runs.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def encode(items: pa.Array, path: str | None = None) -> list[np.ndarray]:
    """Ids of each text of an Arrow array, the end id included.

    The tokenizer's pieces never hold white space, so words between spaces and line feeds are
    encoded alone. Arrow splits the texts, numbers their distinct words and parts these into runs;
    each distinct run is looked up once, and numpy puts the ids of all words in a row.
    """
    lists = pc.split_pattern(pc.replace_substring(pc.fill_null(items, ""), "\n", " "), pattern=" ")
    coded = lists.flatten().dictionary_encode()
    parts = pc.extract_regex(coded.dictionary, pattern=_SIMPLE)
    simple = pc.is_valid(parts).to_numpy(zero_copy_only=False)
    table_of = _runs(path)
    letters, letter_at = _numbered(pc.utf8_lower(pc.fill_null(pc.struct_field(parts, "letters"), "")))
    marks, mark_at = _numbered(pc.fill_null(pc.struct_field(parts, "marks"), ""))
    other = coded.dictionary.filter(pa.array(~simple)).to_pylist()
    found = table_of.lookup(letters) + table_of.lookup(marks) + table_of.others(other)
    # A word is two runs: its letters and its punctuation, or the word and nothing.
    two = np.empty((len(simple), 2), dtype=np.int64)
    two[:, 0], two[:, 1] = letter_at, mark_at + len(letters)
    two[~simple, 0] = len(letters) + len(marks) + np.arange(len(other))
    pieces = np.frombuffer(b"".join(found), dtype="<u4")
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    first = np.cumsum(size) - size
    index = two[coded.indices.to_numpy()].ravel()
    counts = size[index]
    after = np.cumsum(counts)
    ids = pieces[np.repeat(first[index] - (after - counts), counts) + np.arange(int(after[-1]) if len(after) else 0)]
    bounds = np.concatenate([[0], after])[2 * np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
    return [np.append(ids[a:b], np.uint32(END_ID)) for a, b in zip(bounds[:-1], bounds[1:])]


class Packer:
    """Packs pieces (length, order, doc_id, start, ids, doc_tokens) into windows; emits rows of finished sequences.

    A document is cut into whole windows of the longest tier. What is left goes to the shortest
    tier that holds it. Tiers are packed from the longest on: a window takes the longest piece of
    its tier, its gap takes the longest pieces of shorter tiers that fit, and the last bit of the
    gap takes the head of a piece. So no window has padding. What is left at the very end fills no
    window and is cut along the binary digits of its length, into sequences whose lengths are
    powers of two.
    """

    def __init__(self, first_sequence: int):
        self.next, self.order, self.rows = first_sequence, 0, []
        self.pool: list[tuple] = []
        self.groups: dict[int, int] = {}
        self.base = first_sequence

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        start, top = 0, TIERS[0]
        while n - start >= top:
            self.emit([(top, 0, doc_id, start, ids, n)], top)
            start += top
        if start < n:
            self.order += 1
            self.pool.append((n - start, self.order, doc_id, start, ids, n))

    def emit(self, pieces: list[tuple], window: int) -> None:
        filled = self.groups.get(window, 0)
        group = self.base + (window.bit_length() << 32) + filled // GROUP_TOKENS
        self.groups[window] = filled + window
        offset = 0
        for size, _, doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), total, self.next, offset, window, group))
            offset += size
        self.next += 1

    def _fill(self, window: int, got: list[tuple]) -> int:
        """Add pieces of the pool to got until the window is full; what stays open."""
        gap = window - sum(p[0] for p in got)
        while gap and self.pool:
            k = bisect_right(self.pool, (gap, float("inf"))) - 1
            if k >= 0:
                piece = self.pool.pop(k)
            else:
                size, order, doc_id, start, ids, total = self.pool.pop(0)
                piece = (gap, order, doc_id, start, ids, total)
                rest = (size - gap, order, doc_id, start + gap, ids, total)
                self.pool.insert(bisect_left(self.pool, rest[:2]), rest)
            got.append(piece)
            gap -= piece[0]
        return gap

    def pack(self, final: bool) -> None:
        self.pool.sort(key=lambda p: p[:2])
        for window, least in zip(TIERS, (*(t for t in TIERS[1:]), 0)):
            while self.pool and self.pool[-1][0] > least:
                got = [self.pool.pop(bisect_right(self.pool, (window, float("inf"))) - 1)]
                if self._fill(window, got):
                    self.pool = got  # nothing else is left
                    break
                self.emit(got, window)
            else:
                continue
            break
        if final:
            self.pool.sort(key=lambda p: p[:2])
            left = sum(p[0] for p in self.pool)
            for k in reversed(range(left.bit_length())):
                if left >> k & 1:
                    got: list[tuple] = []
                    self._fill(1 << k, got)
                    self.emit(got, 1 << k)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()), ("step_group", pa.int64())]
)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Pack every document into sequences of at most 4096 tokens: one row for each piece.

    Each task packs its own input split, a buffer of bounded size at a time, and carries what does
    not fill a window over; nothing is shuffled. Sequence ids start from the number of the
    partition, so that they are unique, and a task that runs again gives the same ones.
    Cases: a null text counts as empty; an empty text is its end id alone; texts of any length are
    cut, never dropped; repeated rows and null ids are packed like any other row; extra columns
    are not looked at; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = Packer(TaskContext.get().partitionId() << 40), 0

        def ready():
            rows = packer.take()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA) if rows else None

        for part in steps(batches, "text"):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text"), tokenizer)):
                packer.add(doc_id, ids)
                held += len(ids)
            if held >= BUFFER_TOKENS:
                packer.pack(final=False)
                held = 0
            if (out := ready()) is not None:
                yield out
        packer.pack(final=True)
        if (out := ready()) is not None:
            yield out

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long")


def op8_packing(spark, sf_dir):
    """The pieces of all documents, packed into sequences."""
    return pack(table(spark, sf_dir, "documents"))
