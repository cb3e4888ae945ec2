"""Language identification by a blended-spectrum string kernel with Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, held_out, join_sized, map_text, steps, table, texts

#: Documents that the regression is fitted on, at most, and how many of them are landmarks, or one for each language if there are more languages.
MAX_LABELLED, LANDMARKS = 3000, 96
#: Lengths of the n-grams and bits that they are hashed to.
GRAMS, BITS = (1, 2, 3), 14
RIDGE = 1e-2
UNKNOWN = "und"

_WORD_CHAR = re.compile(r"[^\W\d_]")
_ASCII = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
_BLOCK = 128


def has_letter(text: str) -> bool:
    """True if the text has a letter; digits written as fractions or exponents are none."""
    return any(m[0].isalpha() for m in _WORD_CHAR.finditer(text))


def present(text: str) -> np.ndarray:
    """Presence of the hashed n-grams of the lower-cased letters, over whole texts; words are one space apart."""
    raw = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_ASCII).split())
    out = np.zeros(1 << BITS, dtype=bool)
    data = np.frombuffer(b" " + raw + b" ", dtype=np.uint8).astype(np.uint32) if raw else np.zeros(0, np.uint32)
    code = data
    for n in range(1, max(GRAMS) + 1):
        if len(data) < n:
            break
        code = data if n == 1 else (code[:-1] << np.uint32(8)) | data[n - 1 :]
        if n in GRAMS:
            out[(code * np.uint32(2654435761) + np.uint32(n * 97)) * np.uint32(2246822519) >> np.uint32(32 - BITS)] = True
    return out


@dataclass
class Kernel:
    """Landmarks as rows of presences scaled to length one, the languages, and the regression's coefficients."""

    languages: list[str]
    landmarks: np.ndarray
    coef: np.ndarray

    def similarities(self, x: np.ndarray) -> np.ndarray:
        """Normalised kernel values of the rows of presences x with the landmarks: one matrix product."""
        x = x.astype(np.float32)
        return (x @ self.landmarks.T) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language with the largest of the one-versus-rest values, and the value moved from -1..1 to 0..1."""
        f = np.column_stack([np.ones(len(x)), self.similarities(x)]) @ self.coef
        best = f.argmax(axis=1)
        return best, np.clip((f[np.arange(len(x)), best] + 1) / 2, 0, 1)


def learn(docs: DataFrame, max_labelled: int = MAX_LABELLED, n_landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Kernel | None:
    """Fit on at most max_labelled documents outside the held-out fold that have a language and a letter.

    They are those with the smallest hashes of their ids, dealt evenly over the languages as far as
    there are enough; the driver gets their packed presences, 2 KB each. An id with several texts in
    one language counts once. With more than max_labelled languages, so many are learned.
    None without such documents.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    own = lambda: docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    ids = own().where(F.col("lang").isNotNull() & ~held_out("id")).select("id", "lang").distinct().withColumn("h", F.xxhash64("id")).checkpoint()
    counts = ids.groupBy("lang").agg(F.count("*").alias("n")).withColumn("size", F.col("n")).checkpoint()
    n_languages = counts.count()
    if not n_languages:
        return None
    each = max(1, max_labelled // n_languages)
    # A first cut by the hash leaves some 2 * each rows of each language, so that the ranking is small whatever a language has.
    low = join_sized(ids, counts, "lang", "n", "id").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("size") <= 2.0 * each + 40)
    chosen = low.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("nth") <= each)
    # At most max_labelled rows, which are broadcast.
    chosen = chosen.select("id", "lang", "nth").orderBy("nth", "lang").limit(max_labelled)
    sample = own().join(F.broadcast(chosen), ["id", "lang"]).select("text", "lang", "nth")

    def pack(batches):
        for batch in steps(batches, "text"):
            bits = [np.packbits(present(t)).tobytes() if has_letter(t) else None for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), batch.column("lang"), batch.column("nth")], names=["bits", "lang", "nth"])

    packed = sample.mapInArrow(pack, "bits binary, lang string, nth int").groupBy("nth", "lang").agg(F.min("bits").alias("bits"))
    got = sorted((r["nth"], r["lang"], bytes(r["bits"])) for r in packed.where("bits IS NOT NULL").collect())
    if not got:
        return None
    languages = sorted({lang for _, lang, _ in got})
    unpack = lambda rows: np.unpackbits(np.frombuffer(b"".join(b for *_, b in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1)
    marks = unpack(got[: max(n_landmarks, len(languages))]).astype(np.float32)
    marks /= np.sqrt(marks.sum(axis=1))[:, None]
    kernel = Kernel(languages, marks, np.zeros(0))
    k_nm = np.vstack([kernel.similarities(unpack(got[at : at + _BLOCK])) for at in range(0, len(got), _BLOCK)]).astype(float)
    y = np.where(np.array([lang for _, lang, _ in got])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6
    nystrom = vectors[:, good] / np.sqrt(values[good])  # landmarks' similarities to coordinates
    z = np.column_stack([np.ones(len(y)), k_nm @ nystrom])
    ridge = RIDGE * len(y) / 100 * np.eye(z.shape[1])
    ridge[0, 0] = 0
    w = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    kernel.coef = np.vstack([w[:1], nystrom @ w[1:]])
    return kernel


def identify(docs: DataFrame, kernel: Kernel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row for each row of docs.

    Cases: a null text or one without a letter is "und" with score 0, as is every text if nothing was
    learned; texts of any length are read whole; repeated rows and null ids give a row each; of
    equal values the first language in alphabetical order wins; extra columns are not looked at;
    an empty table gives no rows.
    """

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            items = texts(batch)
            lang, score = [UNKNOWN] * len(items), [0.0] * len(items)
            known = [i for i, t in enumerate(items) if has_letter(t)] if kernel else []
            for at in range(0, len(known), _BLOCK):
                part = known[at : at + _BLOCK]
                best, s = kernel.predict(np.array([present(items[i]) for i in part]))
                for i, b, v in zip(part, best.tolist(), s.tolist()):
                    lang[i], score[i] = kernel.languages[b], v
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

        return apply

    return map_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", "doc_id long, lang_pred string, score double", make)


def op10_language(spark, sf_dir):
    """Predicted languages of all documents."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
