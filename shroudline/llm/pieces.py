"""SentencePiece encoding and decoding through a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, table, texts

#: Chunks in a worker's table, and characters of a chunk that is kept in it.
TABLE_CHUNKS, TABLE_CHUNK_CHARS = 500_000, 64

#: The white-space marker; a space and the marker itself are the same to the model.
MARKER = "▁"
#: Texts whose chunks a model with a normaliser that trims, merges or maps white space gives other pieces than the whole.
PROBES = ("a b", " a", "a ", "  a  b  ", "\ta\n b", "a\u3000b", "a\xa0 b", "１ ｂ ﬁ", f"a {MARKER}b", "e\u0301 e", "", " ", "A b C")
_CHUNK = re.compile(r" +[^ ]*")


class Chunks:
    """Segments each distinct marked word once.

    No piece of the model has a marker behind another character (checked on loading), so no merge
    crosses the place before a run of markers: a text is segmented chunk by chunk, a chunk being a
    run of markers and what follows up to the next one. The library puts a marker before each text
    that it encodes; a chunk is therefore encoded without its first one.
    """

    def __init__(self, path: str | None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARKER in p.lstrip(MARKER) for p in pieces) or self.model.encode("a", out_type=str)[0][0] != MARKER:
            raise ValueError("the model has pieces that cross a marker, or adds no marker before a text")
        self.end = self.model.eos_id()
        self.ids: dict[str, list[int]] = {}
        if self.encode(list(PROBES)) != self.model.encode(list(PROBES), add_eos=True):
            raise ValueError("the model normalises texts across white space, so that chunks can't be segmented alone")

    def split(self, text: str) -> list[str]:
        return _CHUNK.findall(f" {text.replace(MARKER, ' ')}") if text else []

    def add(self, chunks: set[str]) -> dict[str, list[int]]:
        """Segment the chunks that are not in the table yet; returns those that are too long for it."""
        new = chunks.difference(self.ids)
        if len(self.ids) + len(new) > TABLE_CHUNKS:
            self.ids, new = {}, chunks
        order = list(new)
        found = dict(zip(order, self.model.encode([c[1:] if len(c) > 1 else "" for c in order], num_threads=1)))
        if " " in found:  # the library gives nothing for an empty text, but a lone marker is a piece
            found[" "] = self.model.encode("a ")[len(self.model.encode("a")) :]
        long = {c: ids for c, ids in found.items() if len(c) > TABLE_CHUNK_CHARS}
        for c in long:
            del found[c]
        self.ids.update(found)
        return long

    def encode(self, items: list[str]) -> list[list[int]]:
        """Ids of each text, the end id last."""
        split = [self.split(t) for t in items]
        chunks: set[str] = set()
        for s in split:
            chunks.update(s)
        long = self.add(chunks)
        look = self.ids.__getitem__ if not long else lambda c: long[c] if c in long else self.ids[c]
        out = []
        for s in split:
            ids: list[int] = []
            for part in map(look, s):
                ids += part
            ids.append(self.end)
            out.append(ids)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.model.decode(x) for x in ids]


@lru_cache(maxsize=2)
def _chunks(path: str | None) -> Chunks:
    """A worker's table for a model; it stays between tasks."""
    return Chunks(path)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the ids of each text with the end id, and the text that they decode to.

    Cases: a null text counts as empty, and an empty text is the end id alone; texts of any length
    are encoded whole; repeated rows and null ids give a row each; extra columns are not looked at;
    an empty table gives no rows.
    """

    def make():
        chunks = _chunks(model)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = chunks.encode(texts(batch))
            columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(chunks.decode(ids), pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

        return apply

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_text(narrow, "text", "doc_id long, n_tokens long, ids array<int>, decoded string", make)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode_decode, with digests in the place of ids and text."""

    def make():
        chunks = _chunks(model)
        name = [str(i) for i in range(chunks.model.get_piece_size())]

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = chunks.encode(texts(batch))
            shown = [hashlib.sha256(" ".join(map(name.__getitem__, x)).encode()).hexdigest() for x in ids]
            back = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in chunks.decode(ids)]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return apply

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_text(narrow, "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op6_sentencepiece(spark, sf_dir):
    """Ids of all documents by the public piece model, and what they decode to, as digests."""
    return digests(table(spark, sf_dir, "documents"))
