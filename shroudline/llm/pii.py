"""Personal data: base patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, table, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card" and len(s) > 37:  # nineteen digits and what may stand between them
        return False
    digits = "".join(_DIGIT.findall(s))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern: found from each "@", so that long words cost no more than their length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns as (start, end, kind), in code points, by start and then kind; leftmost and not overlapping within a kind."""
    out = [(a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- word shapes ----

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A word with one of these is looked at together with its neighbours.
_ANCHOR = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.I)
_PLAIN = "a"
#: Where a text has a word that is not plain: anchors, words that begin with "+" or "(", and those of punctuation alone. All other words have the same features.
_LOOK = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]|(?<![^\x20\x09-\x0D])(?:[+(]|[.,;:!?]+(?![^\x20\x09-\x0D]))", re.I)
_SHAPED = re.compile(r"(?P<sign>[\[({](?:[aA][tT]|[dD][oO][tT])[\])}])|(?P<low>(?:[a-z]|[^\x00-\x7f])+)|(?P<high>[A-Z]+)|(?P<digit>[0-9])")
_SIGN = {"low": "a", "high": "A", "digit": "9"}
#: Length of a shape whose weights are kept in a worker's table; longer ones are worked out each time.
_KEPT_SHAPE = 200
#: Words that are decoded together, padding included; a longer row is decoded alone.
DECODED = 65_536


def shape(word: str) -> str:
    """Letters as a or A, digits as 9, runs of letters shortened to one; bracketed "at" and "dot" and what is no letter or digit stay. Plain words are all alike."""
    return _SHAPED.sub(lambda m: _SIGN.get(m.lastgroup) or m[0].lower(), word) if _LOOK.search(word) else _PLAIN


def shape_features(s: str) -> list[str]:
    """Features of a word shape, alike for shapes that differ in the lengths of long runs only."""
    core = s.strip(".,;:!?%*$&#\"'|<>")
    digits = s.count("9")
    runs = re.sub(r"9+", lambda m: f"9{{{len(m[0])}}}" if len(m[0]) < 5 else "9{+}", core)
    return [
        f"runs={runs}", f"loose={re.sub(r'9+', '9', core)}", f"digits={digits if digits < 12 else '12-19' if digits < 20 else '20+'}",
        f"at={'@' in s or '[at]' in s or '(at)' in s or '{at}' in s}", f"dots={min(core.count('.'), 4)}", f"plus={core.startswith('+')}", f"paren={core.startswith('(') or core.endswith(')')}",
        f"dash={min(core.count('-'), 4)}", f"hexlike={digits >= 3 and 'a' in core and '@' not in core}", f"plain={s == _PLAIN}", f"tail={s[-1:] in '.,;:!?'}", "bias",
    ]


# ---- a small labelled table ----


def labelled_rows(n: int = 600, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Labelled sentences of (word, label), made from a few forms per kind and fillers by a seeded generator."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    fill = "the of and to in that is for on with as at by from this der die und von le la les et que el los de una contact mail call card paid server host number address reach me or us".split()
    word = lambda: "".join(rng.choice(("tion", "er", "an", "lo", "mi", "sta", "reh", "kei", "ou")) for _ in range(rng.randint(1, 3)))
    octet = lambda: str(rng.randint(0, 255))

    def email() -> list[str]:
        user, host = rng.choice((word(), f"{word()}.{d(2)}", f"{word()}_{word()}")), rng.choice((f"{word()}.com", f"mail{d(1)}.example.com", f"{word()}.{word()}.org"))
        return rng.choice(([f"{user}@{host}"], [f"{user}@{host}"], [user, "[at]", host], [user, "(at)", host], [f"{user}[at]{host}"]))

    def card() -> list[str]:
        return rng.choice(([d(16)], [d(4), d(4), d(4), d(4)], [f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"], [f"{d(4)}.{d(4)}.{d(4)}.{d(4)}"], [d(15)]))

    def phone() -> list[str]:
        return rng.choice(([f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"], [f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"], [f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"+{d(2)}", d(3), d(4), d(3)], [f"+{d(11)}"], [f"{d(3)}.{d(3)}.{d(4)}"]))

    def nothing() -> list[str]:
        return rng.choice((["version", f"{d(1)}.{d(1)}."], [f"{rng.randint(1900, 2030)}"], [f"{d(2)}.{d(1)}.{d(4)}"], ["token", "=", '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"'], [f"${d(2)}.{d(2)}"], [d(rng.randint(1, 8))], [f"{d(4)}-{d(2)}-{d(2)}"], [f"{d(1)},{d(3)}"], [f"v{d(1)}.{d(2)}"], [d(24)], [f"{word()}{d(2)}"], [f"{d(2)}:{d(2)}"], [f"@{word()}"], ["(" + word() + ")"]))

    make = {"email": email, "ip": lambda: [".".join(octet() for _ in range(4))], "card": card, "phone": phone}
    rows = []
    for _ in range(n):
        row = [(rng.choice(fill) if rng.random() < 0.6 else word().capitalize(), "O") for _ in range(rng.randint(2, 7))]
        for _ in range(rng.choice((0, 1, 1, 2))):
            kind = rng.choice((*KINDS, None, None))
            words = make[kind]() if kind else nothing()
            labels = ["O"] * len(words) if kind is None else [f"B-{kind}", *[f"I-{kind}"] * (len(words) - 1)]
            if kind and rng.random() < 0.3:
                words[-1] += rng.choice((".", ",", "!!", "%%%", "***", ";"))
            row += list(zip(words, labels))
            row += [(rng.choice(fill) if rng.random() < 0.6 else word(), "O") for _ in range(rng.randint(0, 4))]
        rows.append(row)
    return rows


# ---- the random field ----


class Field:
    """A linear-chain conditional random field; a word's features are those of its own, the previous and the next shape."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.features, self.weights, self.moves, self.start = features, weights, moves, start
        self.cache: dict[str, np.ndarray] = {}
        plain = self.emissions([_PLAIN] * 3)[1]
        best_gain = max((moves[i, k] + moves[k, j] - moves[i, 0] - moves[0, j] for i in range(len(LABELS)) for j in range(len(LABELS)) for k in range(1, len(LABELS))))
        #: True if a plain word among plain words is O on every best path: then only words that aren't plain, and their neighbours, need decoding.
        self.plain_is_outside = bool(plain[0] - plain[1:].max() > best_gain)

    def _table(self, s: str) -> np.ndarray:
        """Weights of a shape as previous, own and next one: (3, labels)."""
        got = self.cache.get(s)
        if got is None:
            got = np.zeros((3, len(LABELS)))
            for f in shape_features(s):
                for k in range(3):
                    at = self.features.get(f"{k}:{f}")
                    if at is not None:
                        got[k] += self.weights[at]
            if len(s) <= _KEPT_SHAPE and len(self.cache) < 100_000:
                self.cache[s] = got
        return got

    def emissions(self, shapes: list[str]) -> np.ndarray:
        tables = np.array([self._table(s) for s in shapes])
        out = tables[:, 1].copy()
        out[1:] += tables[:-1, 0]
        out[:-1] += tables[1:, 2]
        return out

    def viterbi(self, rows: list[tuple[np.ndarray | Emissions, bool]]) -> list[np.ndarray]:
        """Best labels of each row of emissions; flag: a word stands before the row, which is O.

        Rows of similar length are decoded together, as many as make DECODED words with their padding;
        a row that is longer is decoded alone, with a byte a word and label in memory.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(rows)
        order, lo = sorted(range(len(rows)), key=lambda i: len(rows[i][0])), 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * len(rows[order[hi]][0]) <= DECODED:
                hi += 1
            ids, lo = order[lo:hi], hi
            sizes = np.array([len(rows[i][0]) for i in ids])
            longest, k = int(sizes.max()), len(LABELS)
            if longest > DECODED:
                out[ids[0]] = self._long(*rows[ids[0]])
                continue
            e = np.zeros((len(ids), longest, k))
            for r, i in enumerate(ids):
                e[r, : sizes[r]] = rows[i][0][: sizes[r]]
            score = e[:, 0] + np.where(np.array([rows[i][1] for i in ids])[:, None], self.moves[0], self.start)
            back = np.zeros((len(ids), longest, k), dtype=np.int8)
            for t in range(1, longest):
                through = score[:, :, None] + self.moves
                back[:, t] = through.argmax(axis=1)
                score = np.where((t < sizes)[:, None], through.max(axis=1) + e[:, t], score)
            label = score.argmax(axis=1)
            path = np.zeros((len(ids), longest), dtype=np.int8)
            for t in range(longest - 1, -1, -1):
                path[:, t] = label
                label = np.where(t < sizes, back[np.arange(len(ids)), t, label] if t else label, label)
            for r, i in enumerate(ids):
                out[i] = path[r, : sizes[r]]
        return out

    def _long(self, row: np.ndarray | Emissions, after: bool) -> np.ndarray:
        """The same for one long row, whose emissions are made piece by piece."""
        n, at = len(row), np.arange(len(LABELS))
        back, score = np.zeros((n, len(LABELS)), dtype=np.int8), None
        for lo in range(0, n, DECODED):
            for t, e in enumerate(row[lo : lo + DECODED], lo):
                if score is None:
                    score = e + (self.moves[0] if after else self.start)
                    continue
                through = score[:, None] + self.moves
                best = through.argmax(axis=0)
                back[t], score = best, through[best, at] + e
        path = np.zeros(n, dtype=np.int8)
        label = int(score.argmax())
        for t in range(n - 1, -1, -1):
            path[t] = label
            label = int(back[t, label])
        return path


class Emissions:
    """The emissions of words lo to hi of a text, made as they are read."""

    def __init__(self, field: Field, text: str, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int):
        self.field, self.text, self.starts, self.ends, self.lo, self.hi = field, text, starts, ends, lo, min(hi, len(starts))

    def __len__(self) -> int:
        return self.hi - self.lo

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(len(self))
        a, b = self.lo + a, self.lo + b
        first = max(0, a - 1)  # one word more on either side, so that the outer features are right
        wide = zip(self.starts[first : b + 1].tolist(), self.ends[first : b + 1].tolist())
        return self.field.emissions([shape(self.text[x:y]) for x, y in wide])[a - first :][: b - a]


def train(rows: list[list[tuple[str, str]]], rounds: int = 200, rate: float = 0.15, ridge: float = 2e-4) -> Field:
    """Fit the field by Adam on the mean log-likelihood, with scaled forward and backward sums over all rows at once.

    Weights are kept by feature, but summed once for each distinct shape, as a word's emissions are those of three shapes.
    """
    k, n, longest = len(LABELS), len(rows), max(map(len, rows))
    sizes, gold, own = np.array([len(r) for r in rows]), np.zeros((n, longest), int), np.full((n, longest), -1)
    ids: dict[str, int] = {}
    for r, row in enumerate(rows):
        for t, (word, label) in enumerate(row):
            gold[r, t] = LABELS.index(label)
            own[r, t] = ids.setdefault(shape(word), len(ids))
    names: dict[str, int] = {}
    active = [(i, names.setdefault(f, len(names))) for s, i in ids.items() for f in shape_features(s)]
    present = np.zeros((len(ids), len(names)))
    np.add.at(present, tuple(np.array(active).T), 1)
    inside = np.arange(longest) < sizes[:, None]
    none = np.full((n, 1), -1)
    # Shapes of the previous, the own and the next word; where there is none, the row of zeros behind the last shape.
    around = [np.hstack([none, own[:, :-1]]), own, np.hstack([own[:, 1:], none])]
    around = [np.where(inside & (x >= 0), x, len(ids)) for x in around]
    sort = [np.argsort(x.ravel(), kind="stable") for x in around]
    edges = [np.searchsorted(x.ravel()[o], np.arange(len(ids) + 1)) for x, o in zip(around, sort)]
    hot = np.eye(k)[gold] * inside[..., None]
    gold_pairs = np.einsum("rti,rtj->ij", hot[:, :-1], hot[:, 1:])

    def by_shape(values: np.ndarray, j: int) -> np.ndarray:
        """Sums of (n, longest, k) over the places of each shape."""
        total = np.vstack([np.zeros((1, k)), values.reshape(-1, k)[sort[j]].cumsum(axis=0)])
        return np.diff(total[edges[j]], axis=0)

    params = [np.zeros((3, len(names), k)), np.zeros((k, k)), np.zeros(k)]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, rounds + 1):
        weights, moves, start = params
        tables = [np.vstack([present @ weights[j], np.zeros((1, k))]) for j in range(3)]
        e = sum(table[x] for table, x in zip(tables, around))
        e[:, 0] += start
        e = np.exp(e - e.max(axis=2, keepdims=True))
        move = np.exp(moves - moves.max())
        fwd, bwd, scale = np.ones((n, longest, k)), np.ones((n, longest, k)), np.ones((n, longest, 1))
        for t in range(longest):
            here = e[:, t] if not t else (fwd[:, t - 1] @ move) * e[:, t]
            scale[:, t] = here.sum(axis=1, keepdims=True)
            fwd[:, t] = here / scale[:, t]
        pair = np.zeros((k, k))
        for t in range(longest - 1, 0, -1):
            ahead = np.where((t < sizes)[:, None], e[:, t] * bwd[:, t] / scale[:, t], 0)
            pair += fwd[:, t - 1].T @ ahead
            bwd[:, t - 1] = np.where((t < sizes)[:, None], ahead @ move.T, 1)
        diff = fwd * bwd * inside[..., None] - hot
        grads = [
            np.stack([present.T @ by_shape(diff, j) for j in range(3)]) / n + ridge * weights,
            (pair * move - gold_pairs) / n + ridge * moves,
            diff[:, 0].sum(axis=0) / n + ridge * start,
        ]
        for p, g, m in zip(params, grads, moment):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    features = {f"{j}:{f}": j * len(names) + i for f, i in names.items() for j in range(3)}
    return Field(features, params[0].reshape(-1, k), *params[1:])


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field, trained on the labelled table."""
    return train(labelled_rows())


# ---- spans ----


def _accept(kind: str, s: str) -> bool:
    """The checks that a found span of a kind passes; they are those of the base patterns where there are any."""
    digits = "".join(_DIGIT.findall(s))
    if kind == "email":
        return bool(re.search(r"@|[\[({]at[\])}]", s, re.I)) and "." in s
    if kind == "ip":
        return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) is not None and _valid("ip", s)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", s)


def all_spans(items: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans: the base ones and those of the field that overlap none of them."""
    base = [base_spans(t) for t in items]
    rows, where = [], []
    for i, t in enumerate(items):
        looks = np.fromiter((m.start() for m in _LOOK.finditer(t)), dtype=np.int64)
        if not len(looks):
            continue
        edges = np.fromiter((x for m in _WORD.finditer(t) for x in m.span()), dtype=np.int64)
        starts, ends = edges[::2].copy(), edges[1::2].copy()
        if field.plain_is_outside:
            anchors = np.unique(np.searchsorted(starts, looks, "right") - 1)
            apart = np.flatnonzero(np.diff(anchors) > 6)
            windows = list(zip(np.maximum(0, anchors[np.concatenate([[0], apart + 1])] - 3).tolist(), (anchors[np.concatenate([apart, [len(anchors) - 1]])] + 4).tolist()))
        else:
            windows = [(0, len(starts))]
        for lo, hi in windows:
            rows.append((Emissions(field, t, starts, ends, lo, hi), lo > 0))
            where.append((i, starts[lo:hi], ends[lo:hi]))
    found: list[list[Span]] = [[] for _ in items]
    for (i, starts, ends), path in zip(where, field.viterbi(rows)):
        end = 0
        for k in np.flatnonzero(path).tolist():
            if k < end:
                continue
            kind, end = LABELS[path[k]][2:], k + 1
            while end < len(path) and LABELS[path[end]] == f"I-{kind}":
                end += 1
            a, b = int(starts[k]), int(ends[end - 1])
            s = items[i][a:b]
            if m := re.match(r"[^\w+(]+", s):
                a += m.end()
            if m := re.search(r"[^\w)]+$", items[i][a:b]):
                b = a + m.start()
            if a < b and _accept(kind, items[i][a:b]):
                found[i].append((a, b, kind))
    out = []
    for own, more in zip(base, found):
        new = [s for s in more if not any(s[0] < b and a < s[1] for a, b, _ in own)]
        out.append((own, sorted(own + new, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def show(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): counts of the base spans, the base spans and all spans of each text.

    Cases: a null text counts as empty and has no span; texts of any length are read whole, and need about 30 bytes a word to be decoded; repeated
    rows and null ids give a row each; extra columns are not looked at; an empty table gives no rows.
    """

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = all_spans(texts(batch), field)
            counts = [pa.array([sum(s[2] == k for s in own) for own, _ in got], pa.int64()) for k in KINDS]
            shown = [pa.array([show(x[i]) for x in got], pa.string()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *shown], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

        return apply

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_text(narrow, "text", "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string", make)


def mask(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; spans that overlap become one. Null texts stay null."""
    at = docs.columns.index(text_col)

    def masked(text: str, spans: list[Span]) -> str:
        out, last, end = [], 0, -1
        for a, b, kind in spans:
            if a >= end:
                out += [text[last:a], f"[{kind.upper()}]"]
            last = end = max(b, end)
        return "".join(out) + text[last:]

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            items = batch.column(at).to_pylist()
            got = all_spans([t or "" for t in items], field)
            new = pa.array([masked(t, spans) if spans else t for t, (_, spans) in zip(items, got)], pa.string())
            return pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

        return apply

    return map_text(docs, text_col, docs.schema, make)


def op1_pii(spark, sf_dir):
    """Personal data of all documents."""
    found = detect(table(spark, sf_dir, "documents"), trained())
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
