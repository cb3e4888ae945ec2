"""Quality rules: base counts, and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, map_text, steps, table, texts
from .toxicity import fit_logistic, labelled, logistic

#: Labelled rows that the model is fitted on, at most; a fifth of them are for the calibration, if each class has so many rows.
MAX_LABELLED, MIN_CLASS = 3000, 10
#: Documents that are scored by one matrix product.
BLOCK = 64
#: Hash buckets of the n-grams.
BUCKETS = 4096
#: Fixed thresholds: least words, most repeated words in percent, least probability of good quality.
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_PROBABILITY = 20, 30, 0.5
#: Words of a window that counts as repeated if the text has it twice.
WINDOW = 8

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words inside windows that occur twice or more. Hashes (one a word) propose windows, the words themselves decide."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    key = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    order = np.sort(key)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return 0
    places = np.flatnonzero(np.isin(key, again)).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in places]
    found = Counter(windows)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(places, windows):
        if found[w] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text: str, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words, hashes),
    )


def split_words(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    words = raw.split()
    return words, np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))


def vector(raw: bytes, hashes: np.ndarray) -> np.ndarray:
    """Log counts of the hashed byte 1- to 3-grams and word 1- and 2-grams, of length one."""
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    grams, code = [], data
    for n in (1, 2, 3):
        if len(data) < n:
            break
        code = data if n == 1 else (code[:-1] << np.uint32(8)) | data[n - 1 :]
        grams.append((code * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> _SHIFT)
    short = hashes.astype(np.uint32)
    if len(short):
        grams.append(short * np.uint32(3266489917) >> _SHIFT)
        grams.append((short[:-1] * np.uint32(668265263) + short[1:]) * np.uint32(374761393) >> _SHIFT)
    x = np.zeros(BUCKETS)
    for g in grams:
        x += np.bincount(g, minlength=BUCKETS)
    x = np.log1p(x)
    return x / (np.sqrt(x @ x) or 1.0)


@dataclass
class Model:
    """Weights of the buckets, and the two numbers of the calibration; without weights every text is good."""

    weights: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(x))
        return logistic(self.slope * (x @ self.weights) + self.offset)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 3e-3, rounds: int = 300) -> np.ndarray:
    """Logistic regression with classes weighted alike, by accelerated gradient steps."""
    n = len(y)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    ahead, rate, center = w.copy(), 4.0, x.mean(axis=0)
    for k in range(rounds):
        p = logistic((x @ ahead - center @ ahead).astype(float)).astype(np.float32)
        diff = (p - y) * share
        grad = x.T @ diff - center * diff.sum() + ridge / 100 * ahead
        new = ahead - rate * grad
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    assert n == len(x)
    return w


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the model on at most max_labelled labelled rows (labels: doc_id, quality) outside the held-out fold.

    The driver gets one vector of BUCKETS half-precision numbers for each of these rows. Every fifth
    row of each class is kept from the fit and serves the calibration; where a class has under
    MIN_CLASS rows, all rows serve the fit and there is no calibration. Without rows of both
    classes there is no model.
    """
    ensure_checkpoint_dir(docs.sparkSession)

    def vectors(batches):
        for batch in steps(batches, "text"):
            rows = []
            for t in texts(batch):
                raw = t.encode("utf-8", "surrogatepass")
                rows.append(vector(raw, split_words(raw)[1]).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("y")], names=["x", "y"])

    got = labelled(docs, labels, "quality", max_labelled, id_col, text_col).mapInArrow(vectors, "x binary, y int").collect()
    got.sort(key=lambda r: (zlib.crc32(bytes(r["x"])), bytes(r["x"]), r["y"]))  # the same model whatever the order of the tasks
    y = np.array([r["y"] for r in got], dtype=np.float32)
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    if not all(map(len, classes)):
        return Model()
    calibrate = np.zeros(len(y), dtype=bool)
    if min(map(len, classes)) >= MIN_CLASS:
        for rows in classes:
            calibrate[rows[::5]] = True
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), dtype=np.float16).reshape(-1, BUCKETS).astype(np.float32)
    weights = fit(x[~calibrate], y[~calibrate])
    if not calibrate.any():
        return Model(weights.astype(float), 1.0, float(-(x @ weights).mean()))
    z = (x[calibrate] @ weights).astype(float)
    scale = z.std() or 1.0
    offset, slope = fit_logistic(np.column_stack([np.ones(len(z)), (z - z.mean()) / scale]), y[calibrate].astype(float), ridge=0.05)
    return Model(weights.astype(float), float(slope / scale), float(offset - slope * z.mean() / scale))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the base counts, base_failed, kept and the probability of good quality.

    Cases: a null or empty text has no words and fails the base rules; texts of any length are read
    whole; repeated rows and null ids give a row each; extra columns are not looked at; an empty
    table gives no rows.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, p, block = [], [], []
            for t in texts(batch):
                raw = t.encode("utf-8", "surrogatepass")
                words, hashes = split_words(raw)
                counts.append(base_counts(t, words, hashes))
                block.append(vector(raw, hashes))
                if len(block) == BLOCK:
                    p += model.probability(np.array(block)).tolist()
                    block = []
            if block:
                p += model.probability(np.array(block)).tolist()
            failed = [c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0] for c in counts]
            kept = [not f and x >= MIN_PROBABILITY for f, x in zip(failed, p)]
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(failed), pa.array(kept), pa.array(p, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "kept", "probability"])

        return apply

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_text(narrow, "text", f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, probability double", make)


def op5_quality(spark, sf_dir):
    """Quality counts and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
