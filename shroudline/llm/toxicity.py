"""Toxicity by a weighted lexicon that is matched with Aho-Corasick on folded text."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, held_out, map_text, steps, table, texts

#: Labelled rows that the lexicon and the score are learned from, at most; the rows with the smallest id hashes.
MAX_LABELLED = 6000
#: Documents of the positive class that an entry of the lexicon is found in at least.
MIN_DOCS = 5
#: Least log ratio of an entry's rates in the two classes.
MIN_WEIGHT = 2.0
#: Documents of the negative class that a phrase with a match is found in at least to be an exception; none of the positive class may have it.
MIN_CLEAN_DOCS = 5
#: Word beginnings of these lengths are candidates besides whole words.
PREFIXES = range(3, 9)
#: Harmless phrases besides those that are learned: lexicon matches inside them don't count.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "pathetic fallacy", "class clown college")

# Look-alikes of Latin letters, and other characters that are written in their place. Fixed values.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "г": "r", "η": "n", "ω": "w", "γ": "y", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ħ": "h", "ŧ": "t",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_PLAIN = re.compile(r"[^\x00-\x7fß-öø-ÿ]")
_SUBST = re.compile(r"(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])|(?<![\w@$])[013457@$]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+(?![\w@$])")
_DIGIT_TABLE = str.maketrans(DIGITS)
_GLYPH_TABLE = str.maketrans(HOMOGLYPHS)
_ASCII = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def fold(text: str) -> str:
    """Lower-case text with look-alikes and digit substitutions folded to letters, and anything but letters turned to spaces."""
    t = text.lower()
    if _PLAIN.search(t):
        t = unicodedata.normalize("NFKC", t).lower().translate(_GLYPH_TABLE)
        t = "".join(c if c.isalpha() or c < "\x80" else "" if unicodedata.category(c) in ("Mn", "Cf") else " " for c in t)
    if any(d in t for d in DIGITS):
        t = _SUBST.sub(lambda m: m[0].translate(_DIGIT_TABLE), t)
    return t.encode("utf-8", "surrogatepass").translate(_ASCII).decode("utf-8", "surrogatepass")


def candidates(words: list[str]) -> Counter:
    """Occurrences of the lexicon's candidates: " word " for a whole word and " pre" for a word's beginning."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[f" {w} "] += n
        for k in PREFIXES:
            if len(w) > k:
                out[f" {w[:k]}"] += n
    return out


@dataclass
class Lexicon:
    """Weights of the entries, exception phrases, and the logistic score over the features."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    coef: tuple[float, ...] | None = None

    def matcher(self):
        """A function from text to (weight a 100 words, matches a 100 words, matches)."""
        machine = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            machine.add_word(entry, (len(entry), w))
        for phrase in self.exceptions if self.weights else ():
            entry = f" {' '.join(fold(phrase).split())} "
            machine.add_word(entry, (len(entry), None))
        if len(machine):
            machine.make_automaton()

        def features(text: str) -> tuple[float, float, float]:
            words = fold(text).split()
            if not words or not len(machine):
                return 0.0, 0.0, 0.0
            best: dict[int, float] = {}
            spared: list[tuple[int, int]] = []  # in the order of their ends, which grow; none holds another, so their starts grow, too
            for end, (size, w) in machine.iter(f" {' '.join(words)} "):
                if w is None:
                    while spared and spared[-1][0] >= end - size + 1:
                        spared.pop()
                    spared.append((end - size + 1, end))
                elif w > best.get(end - size + 1, 0.0):
                    best[end - size + 1] = w
            if spared:
                best = {at: w for at, w in best.items() if not inside(at, spared)}
            per = 100.0 / len(words)
            return sum(best.values()) * per, len(best) * per, float(len(best))

        return features

    def phrases(self):
        """A function from folded words to the pairs of neighbours of which one is matched."""
        machine, known = ahocorasick.Automaton(), {}
        for entry in self.weights:
            machine.add_word(entry, len(entry))
        if len(machine):
            machine.make_automaton()

        def matched(word: str) -> bool:
            hit = known.get(word)
            if hit is None:
                hit = known[word] = len(machine) > 0 and any(end == size - 1 for end, size in machine.iter(f" {word} "))
            return hit

        return lambda words: {f"{a} {b}" for a, b in zip(words, words[1:]) if matched(a) or matched(b)}

    def scorer(self):
        """A function from text to a score between 0 and 1."""
        features, coef = self.matcher(), self.coef
        if coef is None:
            return lambda text: 0.0
        return lambda text: float(logistic(design(np.array([features(text)])) @ np.array(coef))[0])


def inside(at: int, spans: list[tuple[int, int]]) -> bool:
    """True if one of the half-open spans, whose starts and ends both grow, holds the place."""
    k = bisect_right(spans, at, key=lambda s: s[0]) - 1
    return k >= 0 and at < spans[k][1]


def design(x: np.ndarray) -> np.ndarray:
    """Columns of the logistic score: a constant, and the logs of the features, so that length alone moves nothing."""
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(x[:, 1]), np.log1p(x[:, 2])])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Newton's method for logistic regression with a ridge term."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = logistic(x @ w)
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most max_rows labelled rows outside the held-out fold, those with the smallest hashes of their ids.

    An id that is labelled more than once counts once, with its largest label, and of several texts
    of one id the smallest. The ids are broadcast: max_rows bounds their number.
    """
    ids = (
        labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "__id").groupBy("__id", "y").agg(F.min("text").alias("text")).select("text", "y")


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn the lexicon's weights and the score from labelled rows (labels: doc_id, toxic).

    Occurrences are counted in the tasks, summed by Spark, and filtered there; the driver gets the
    entries that at least MIN_DOCS of the at most max_labelled rows have, and three numbers for each of these rows.
    Exception phrases are learned, too: two words with a match that MIN_CLEAN_DOCS clean rows have and no toxic one; the given ones join them.
    Without rows of both classes the lexicon is empty and every score is 0.
    """
    sample = labelled(docs, labels, "toxic", max_labelled, id_col, text_col).checkpoint()

    def count(batches):
        for batch in steps(batches, "text"):
            occ: tuple[Counter, Counter] = (Counter(), Counter())
            found: Counter = Counter()
            total = [0, 0]
            for text, y in zip(texts(batch), batch.column("y").to_pylist()):
                words = fold(text).split()
                total[y] += len(words)
                c = candidates(words)
                occ[y].update(c)
                if y:
                    found.update(c.keys())
            rows = [("", total[1], total[0], 0)] + [(e, n, occ[0][e], found[e]) for e, n in occ[1].items()]
            rows += [(e, 0, n, 0) for e, n in occ[0].items() if e not in occ[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["entry", "pos", "neg", "docs"])

    counts = sample.mapInArrow(count, "entry string, pos long, neg long, docs long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("docs").alias("docs")).checkpoint()
    totals = counts.where("entry = ''").first()
    if totals is None or not totals["pos"] or not totals["neg"]:
        return Lexicon(exceptions=exceptions)
    weight = F.log((F.col("pos") + 0.5) / (totals["pos"] + 1.0)) - F.log((F.col("neg") + 0.5) / (totals["neg"] + 1.0))
    top = counts.where(f"entry <> '' AND docs >= {MIN_DOCS}").withColumn("w", weight).where(F.col("w") >= MIN_WEIGHT)
    lexicon = Lexicon(prune({r["entry"]: float(r["w"]) for r in top.collect()}), exceptions)

    def pair(batches):
        pairs = lexicon.phrases()
        for batch in steps(batches, "text"):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(texts(batch), batch.column("y").to_pylist()):
                seen[y].update(pairs(fold(text).split()))
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[p] for p in names], pa.int64()) for c in seen]], names=["phrase", "clean", "toxic"])

    harmless = sample.mapInArrow(pair, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(f"clean >= {MIN_CLEAN_DOCS} AND toxic = 0")
    lexicon.exceptions = tuple(sorted({*exceptions, *(r["phrase"] for r in harmless.collect())}))

    def measure(batches):
        features = lexicon.matcher()
        for batch in steps(batches, "text"):
            x = np.array([features(t) for t in texts(batch)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(3)), batch.column("y")], names=["a", "b", "c", "y"])

    data = np.array([tuple(r) for r in sample.mapInArrow(measure, "a double, b double, c double, y int").collect()], dtype=float).reshape(-1, 4)
    data = data[np.lexsort(data.T)]  # the same sums whatever the order of the tasks
    lexicon.coef = tuple(fit_logistic(design(data), data[:, 3]).tolist())
    return lexicon


def prune(weights: dict[str, float]) -> dict[str, float]:
    """Drop entries that an at least as heavy shorter beginning covers: they add nothing to any score."""
    out = {}
    for entry, w in weights.items():
        stem = entry.rstrip()
        if not any(weights.get(stem[:k], 0.0) >= w for k in range(4, len(stem) + (entry != stem)) if stem[:k] != entry):
            out[entry] = w
    return out


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row for each row of docs; null and empty texts have no match and so the score of a clean text."""

    def make():
        score = lexicon.scorer()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([score(t) for t in texts(batch)], pa.float64())], names=["doc_id", "score"])

        return apply

    return map_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", "doc_id long, score double", make)


def reject_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the threshold; columns unchanged.

    Cases: null and empty texts have no match and stay, as do all rows where nothing was learned; repeated rows
    and rows without an id are judged by their texts alone; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def make():
        score = lexicon.scorer()

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

        return apply

    return map_text(docs, text_col, docs.schema, make)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: doc_id, held_out, score, predicted.

    Cases: a null or empty text scores as one without a match; repeated rows score alike; labels of
    unknown documents, null labels and null ids are ignored in learning; without labels every score
    is 0; extra columns are not looked at; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, lexicon)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
