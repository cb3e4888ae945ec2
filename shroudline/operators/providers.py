"""Model-backed detection: a provider answers for batches of pages; what fails is tried again, then halved.

A provider is a callable that is shipped to the tasks: from a Request to a dict with payload (JSON
text) and usage (tokens_in and so on, see USAGE), or None where it failed or the item was too large.
An answer without findings is final; None is not, and an exception counts as None. What gets no answer
is halved by its task at once, depth first, until its parts are answered or can't be halved.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import written
from ..functions.stores import AnswerStore
from ..functions.text import READ_SECONDS, document_block, serialize_blocks, serialize_flat, static_prefix, system_text
from .findings import dedupe, parse_own_pages, translate
from .planning import OVERLAP, batches
from .selection import slice_words


@dataclass(frozen=True)
class Request:
    """One attempt of a call. system and prefix are the same for all batches of a submission, so that a provider can cache them; document is not.

    key is the same for all attempts at what is asked, for providers that tell repeated requests by it.
    """

    document: str
    prefix: str = ""
    system: str = ""
    categories: list[str] = field(default_factory=list)
    instructions: list[str] = field(default_factory=list)
    model: str = "default"
    attempt: int = 0
    seed: int | None = None
    key: str = ""

    @property
    def prompt(self) -> str:
        return self.prefix + self.document

    @property
    def timeout(self) -> float:
        """Seconds that the attempt may take: each one as much more as the first."""
        return READ_SECONDS * (self.attempt + 1)


Provider = Callable[[Request], dict | None]

#: Providers by name, each made from a model's name and options.
PROVIDERS: dict[str, Callable[..., Provider]] = {}


def register(name: str):
    """Register a maker of providers under a name."""

    def add(make: Callable[..., Provider]) -> Callable[..., Provider]:
        PROVIDERS[name] = make
        return make

    return add


def make_provider(name: str, model: str, **options) -> Provider:
    """The provider of a name; ValueError for an unknown one."""
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name!r}; there are {', '.join(sorted(PROVIDERS)) or 'none'}")
    return PROVIDERS[name](model, **options)


#: Whole numbers that an answer may carry; what is missing or no number counts as 0.
USAGE = ("tokens_in", "tokens_out", "duration_ms", "cache_creation_input_tokens", "cache_read_input_tokens")


def usage(answer: dict, name: str) -> int:
    try:
        return int(answer.get(name) or 0)
    except (TypeError, ValueError):
        return 0


SCHEMA_HINT = '{"findings": [{"page": int, "start": int, "end": int, "kind": str, "confidence": "high|medium|low"}]}'


class CallFailed(RuntimeError):
    """An item that can't be halved failed on every attempt."""


def work_items(pages: DataFrame, pages_per_batch: int, submissions: DataFrame) -> DataFrame:
    """An item for each batch and submission: (doc_id, batch_idx, ord, path, pages, w0, w1, model, category_ids, instructions).

    The submissions are as few as a rule pack has models and a user instructions; they become a
    literal of the plan. One page alone carries its range of words.
    """
    plans = [(r["ord"], r["model"], list(r["category_ids"]), list(r["instructions"])) for r in submissions.collect()]
    each = [F.struct(F.lit(o).alias("ord"), F.lit(m).alias("model"), F.lit(c).cast("array<string>").alias("category_ids"), F.lit(i).cast("array<string>").alias("instructions")) for o, m, c, i in plans]
    if not each:
        raise ValueError("there is no submission")
    sizes = pages.select("doc_id", "page", F.size("words").alias("n"))
    grouped = batches(pages, pages_per_batch).join(sizes, ["doc_id", "page"]).groupBy("doc_id", "batch_idx").agg(F.array_sort(F.collect_list("page")).alias("pages"), F.sum("n").cast("int").alias("n"))
    alone = F.size("pages") == 1
    items = grouped.select("doc_id", "batch_idx", F.lit("").alias("path"), "pages", F.when(alone, F.lit(0)).alias("w0"), F.when(alone, F.col("n")).alias("w1"))
    return items.select("*", F.inline(F.array(*each)))


def with_prompts(items: DataFrame, pages: DataFrame, layout_aware: bool = False) -> DataFrame:
    """Items with their prefix and the text of their pages (document), with blocks if layout_aware; a range of words is numbered from 0."""
    rows = items.select("*", F.posexplode("pages").alias("nth", "page")).join(pages.select("doc_id", "page", "words"), ["doc_id", "page"])
    words = F.when(F.col("w0").isNull(), F.col("words")).otherwise(slice_words(F.col("words"), F.coalesce("w0", F.lit(0)), F.coalesce("w1", F.lit(0))))
    key = [c for c in items.columns if c != "pages"]
    text = F.struct("nth", "page", (serialize_blocks if layout_aware else serialize_flat)(F.col("page"), words).alias("s"))
    back = rows.groupBy(*key).agg(F.array_sort(F.collect_list(text)).alias("t"))
    prefix = static_prefix(F.col("category_ids"), F.col("instructions"), SCHEMA_HINT)
    return back.select(*key, F.transform("t", lambda x: x["page"]).alias("pages"), prefix.alias("prefix"), document_block(F.transform("t", lambda x: x["s"])).alias("document"))


def with_contents(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with the words and blocks of their pages, in order (contents), from which a task makes prompts of any part of them."""
    rows = items.select("*", F.posexplode("pages").alias("nth", "page")).join(pages.select("doc_id", "page", "words"), ["doc_id", "page"])
    key = [c for c in items.columns if c != "pages"]
    of = lambda name: F.transform("words", lambda w: w[name]).alias(name)
    back = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", "page", of("text"), of("block_id")))).alias("contents"))
    return back.select(*key, static_prefix(F.col("category_ids"), F.col("instructions"), SCHEMA_HINT).alias("prefix"), "contents")


#: Stands between the words of a page where it is in none of them.
SEPARATOR = "\x1f"


def gathered(pages: DataFrame, pages_per_batch: int, with_blocks: bool = False) -> DataFrame:
    """(doc_id, batch_idx, contents) of each batch: pages in order, their words as one text (joined), or as they are (texts) where a word holds the separator or is null, and their blocks if asked for.

    Texts are shuffled once, whatever the number of submissions; nothing is joined.
    """
    words = F.transform("words", lambda w: w["text"])
    blocks = F.transform("words", lambda w: w["block_id"]) if with_blocks else F.lit(None).cast("array<int>")
    rows = pages.select("doc_id", "page", F.array_join(words, SEPARATOR).alias("joined"), "words")
    plain = F.length("joined") - F.length(F.replace("joined", F.lit(SEPARATOR), F.lit(""))) == F.size("words") - 1
    slim = rows.select("doc_id", "page", F.when(plain, F.col("joined")).alias("joined"), F.when(~plain, words).alias("texts"), blocks.alias("blocks"))
    page = F.struct("page", "joined", "texts", "blocks")
    return batches(slim, pages_per_batch, "joined", "texts", "blocks").groupBy("doc_id", "batch_idx").agg(F.array_sort(F.collect_list(page)).alias("contents"))


_NUMBERS: list[str] = []


def _shown(number: int, words: list[str], blocks: list[int] | None) -> str:
    """A page in its tag, the words numbered from 0; with a tag for each run of words of one block if there are blocks."""
    while len(_NUMBERS) < len(words):
        _NUMBERS.append(f"[{len(_NUMBERS)}]")
    numbered = map(add, _NUMBERS, words)
    if blocks is None:
        body = " ".join(numbered)
    else:
        pieces = []
        for i, word in enumerate(numbered):
            opens = i == 0 or blocks[i] != blocks[i - 1]
            tag = f'<block id="{blocks[i]}">' if opens else ""
            pieces.append(("</block>\n" if i else "") + tag if opens else " ")
            pieces.append(word)
        body = "".join(pieces) + ("</block>" if words else "")
    return f'<page n="{number}">\n{body}\n</page>'


def document(contents: list[dict], w0: int | None = None, w1: int | None = None, layout_aware: bool = False) -> str:
    """The text of pages in a prompt, as with_prompts gives it; a range of words of one page is numbered from 0."""
    shown = [_shown(page["page"], list(map(str, page["text"][w0:w1])), list(page["block_id"][w0:w1]) if layout_aware else None) for page in contents]
    return "<document>\n" + "\n".join(shown) + "\n</document>"


class Item:
    """The pages of a batch in a task, and the documents of its parts, each made once for all submissions."""

    def __init__(self, contents: list[dict], layout_aware: bool):
        self.pages = [int(p["page"]) for p in contents]
        self.words = [p["joined"].split(SEPARATOR) if p["joined"] is not None else list(map(str, p["texts"])) for p in contents]
        self.blocks = [p["blocks"] if layout_aware else None for p in contents]
        self.sizes = list(map(len, self.words))
        self._whole: dict[int, str] = {}
        self._made: dict[tuple, tuple[str, bytes, bytes]] = {}

    def _page(self, i: int, w0: int | None, w1: int | None) -> str:
        if (w0 or 0, self.sizes[i] if w1 is None else w1) != (0, self.sizes[i]):
            return _shown(self.pages[i], self.words[i][w0:w1], self.blocks[i] and self.blocks[i][w0:w1])
        if i not in self._whole:
            self._whole[i] = _shown(self.pages[i], self.words[i], self.blocks[i])
        return self._whole[i]

    def document(self, part: Part) -> tuple[str, bytes, bytes]:
        """The document of a part, its bytes, and those of its JSON without the first quote."""
        key = (part.first, part.last, part.w0, part.w1)
        if key not in self._made:
            text = "<document>\n" + "\n".join(self._page(i, part.w0, part.w1) for i in range(part.first, part.last)) + "\n</document>"
            self._made[key] = text, text.encode(), json.dumps(text)[1:].encode()
        return self._made[key]

    def whole(self) -> Part:
        """All of it; one page alone carries its range of words."""
        return Part("", 0, len(self.pages), *((0, self.sizes[0]) if len(self.pages) == 1 else (None, None)))


@dataclass(frozen=True)
class Part:
    """A part of an item: pages from first to last, or words w0 to w1 of one page."""

    path: str
    first: int
    last: int
    w0: int | None
    w1: int | None

    def halves(self, sizes: list[int]) -> list[Part]:
        """Its halves by planning.halves, given the words of the item's pages; none at the floor."""
        n = self.last - self.first
        if n >= 2:
            cut = self.first + n // 2
            spans = [(self.first, cut), (cut, self.last)]
            whole = [(0, sizes[a]) if b - a == 1 else (None, None) for a, b in spans]
            return [Part(self.path + side, a, b, *w) for side, (a, b), w in zip("LR", spans, whole)]
        w0, w1 = self.w0 or 0, sizes[self.first] if self.w1 is None else self.w1
        if w1 - w0 <= 2 * OVERLAP:
            return []
        half = (w1 - w0) // 2 + OVERLAP
        return [Part(f"{self.path}L", self.first, self.last, w0, w0 + half), Part(f"{self.path}R", self.first, self.last, w1 - half, w1)]


def waits(max_retries: int, backoff: float, multiplier: float) -> list[float]:
    """Seconds before each retry."""
    return [backoff * multiplier**k for k in range(max_retries)]


CALL = (
    "payload string, answered boolean, attempts int, temperature double, seed_honored boolean, system_fingerprint string, prompt_sha256 string, response_sha256 string, "
    + ", ".join(f"{c} long" for c in USAGE)
)


ITEM = "doc_id long, batch_idx int, ord int, path string, pages array<int>, w0 int, w1 int, model string, category_ids array<string>, instructions array<string>"

#: What a task writes of a call: sizes are the words of its pages; what all calls of a submission share is added when the calls are read.
MADE = "doc_id long, batch_idx int, ord int, path string, pages array<int>, sizes array<int>, w0 int, w1 int, " + CALL
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
_names = lambda schema: [c.split()[0] for c in schema.split(", ")]


@dataclass(frozen=True)
class Submission:
    """What is asked of every batch, with the prefix of its prompts."""

    ord: int
    model: str
    category_ids: list[str]
    instructions: list[str]
    prefix: str


def asked(submissions: DataFrame) -> list[Submission]:
    """The submissions, as few as a rule pack has models and a user instructions; ValueError if there is none."""
    rows = submissions.select("ord", "model", "category_ids", "instructions", static_prefix(F.col("category_ids"), F.col("instructions"), SCHEMA_HINT).alias("prefix")).collect()
    if not rows:
        raise ValueError("there is no submission")
    return [Submission(r["ord"], r["model"], list(r["category_ids"]), list(r["instructions"]), r["prefix"]) for r in rows]


def call(
    batched: DataFrame, plans: list[Submission], provider: Provider, max_retries: int, parallel: int, *, backoff: float = 1.0, multiplier: float = 2.0, seed: int | None = None, layout_aware: bool = False,
    max_levels: int | None = None, store: AnswerStore | None = None, run_id: str = "",
) -> DataFrame:
    """Call the provider for each batch (gathered) and submission, again up to max_retries times where it gives None, waiting longer each time; parallel tasks call at once at most.

    A task makes the calls of all submissions for its batches, so that texts are not multiplied on their way to it.
    What gets no answer is halved in the task, depth first: a row for each answered part, and for each that can't be halved any more
    or has been halved max_levels - 1 times. With a store, an answer is put there as it comes, under a hash of
    all that is asked, and is looked for before a call; what fails counts for the run of run_id only.
    """
    system, pauses = system_text(layout_aware), waits(max_retries, backoff, multiplier)
    schema = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in MADE.split(", ")])

    class Hashes:
        """Of a submission: of the JSON of system, prompt, model and seed, and of system and prompt; a document ends the prompt, and all before it is hashed once."""

        def __init__(self, plan: Submission):
            self.before, self.after = hashlib.sha256(f"[{json.dumps(system)}, {json.dumps(plan.prefix)[:-1]}".encode()), f", {json.dumps(plan.model)}, {json.dumps(seed)}]".encode()
            self.plain = hashlib.sha256((system + plan.prefix).encode())

        def key(self, as_json: bytes) -> str:
            h = self.before.copy()
            h.update(as_json)
            h.update(self.after)
            return h.hexdigest()

        def prompt(self, raw: bytes) -> str:
            h = self.plain.copy()
            h.update(raw)
            return h.hexdigest()

    def ask(made: Request) -> tuple[dict | None, int]:
        """The answer, and the attempts that it took."""
        known = store.get(made.key) if store else None
        if known and (known["answer"] is not None or known["run_id"] == run_id):
            return known["answer"], known["attempts"]
        answer = None
        for attempt in range(max_retries + 1):
            if attempt:
                time.sleep(pauses[attempt - 1])
            try:
                answer = provider(Request(**{**made.__dict__, "attempt": attempt}) if attempt else made)
            except Exception:  # noqa: BLE001 - whatever a provider raises, the item was not answered
                logging.getLogger(__name__).warning("attempt %d failed", attempt + 1, exc_info=True)
            if answer is not None:
                break
        if store:
            if known:
                store.drop(made.key)
            store.put(made.key, {"answer": answer, "attempts": attempt + 1, "run_id": run_id})
        return answer, attempt + 1

    def parts(doc_id: int, batch_idx: int, item: Item, plan: Submission, hashes: Hashes) -> Iterator[tuple]:
        todo = [item.whole()]
        while todo:
            part = todo.pop()
            text, raw, as_json = item.document(part)
            made = Request(text, plan.prefix, system, list(plan.category_ids), list(plan.instructions), plan.model, 0, seed, hashes.key(as_json))
            answer, attempts = ask(made)
            if answer is None and (max_levels is None or len(part.path) + 1 < max_levels):
                if halves := part.halves(item.sizes):
                    todo += reversed(halves)
                    continue
            got = answer or {}
            payload = str(got.get("payload", ""))
            print_ = got.get("system_fingerprint")
            yield (
                doc_id, batch_idx, plan.ord, part.path, item.pages[part.first : part.last], item.sizes[part.first : part.last], part.w0, part.w1,
                payload, answer is not None, attempts, float(got.get("temperature") or 0.0), bool(got.get("seed_honored", False)), None if print_ is None else str(print_),
                hashes.prompt(raw), hashlib.sha256(payload.encode()).hexdigest(), *[usage(got, c) for c in USAGE],
            )

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
        hashed = [(plan, Hashes(plan)) for plan in plans]
        for frame in frames:
            held: list[tuple] = []
            for i in range(frame.num_rows):
                doc_id, batch_idx, contents = (frame.column(c)[i].as_py() for c in ("doc_id", "batch_idx", "contents"))
                item = Item(contents, layout_aware)
                for plan, hashes in hashed:
                    held += parts(doc_id, batch_idx, item, plan, hashes)
                if len(held) >= 256:
                    yield rows(held)
                    held = []
            if held:
                yield rows(held)

    return batched.repartition(parallel, "doc_id", "batch_idx").mapInArrow(run, MADE)


def call_records(calls: DataFrame, seed: int | None = None) -> DataFrame:
    """The answered calls (as detect gives them) with the fields of their audit lines: chunk_idx counts a document's calls from 0."""
    order = Window.partitionBy("doc_id").orderBy("batch_idx", "ord", "path")
    span = F.when(F.col("w0").isNotNull(), F.array("w0", "w1"))
    return calls.where("answered").select("*", (F.row_number().over(order) - 1).alias("chunk_idx"), F.lit(seed).cast("long").alias("seed_requested"), span.alias("page_word_range"))


def detect(
    pages: DataFrame, submissions: DataFrame, provider: Provider, *, pages_per_batch: int = 1, max_retries: int = 0, parallel: int = 4, max_levels: int | None = None, strict: bool = True,
    backoff: float = 1.0, multiplier: float = 2.0, seed: int | None = None, layout_aware: bool = False, store: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, calls, failed) of a provider over all pages and submissions.

    All calls are one job. Answers are written to the checkpoint folder, as Parquet, before anything reads them; with a
    store, a folder that tasks share, a task also puts each answer there as it comes, so that neither the attempt of a
    lost task nor another run makes a call twice. Findings of halves are moved to their page and
    deduplicated within the item that was halved; those of different items or submissions are not.
    With strict an item that can't be halved any more raises CallFailed, otherwise it is a row of
    failed. Halving goes on until nothing is lost, which the size of the pages bounds; with max_levels, what
    the last level loses counts as failed.
    """
    plans = asked(submissions)
    options = {"backoff": backoff, "multiplier": multiplier, "seed": seed, "layout_aware": layout_aware, "max_levels": max_levels}
    made = call(gathered(pages, pages_per_batch, layout_aware), plans, provider, max_retries, parallel, store=AnswerStore(store) if store else None, run_id=uuid.uuid4().hex, **options)
    of = F.create_map(*[x for p in plans for x in (F.lit(p.ord), F.struct(F.lit(p.model).alias("model"), F.lit(p.category_ids).cast("array<string>").alias("category_ids"), F.lit(p.instructions).cast("array<string>").alias("instructions")))])
    kept = written(made, "calls").select("*", of[F.col("ord")].alias("s")).select("*", "s.*").drop("s")
    got = kept.select(*_names(ITEM), *_names(CALL))
    calls, failed = got.where("answered"), got.where("NOT answered").select(*_names(ITEM))
    if strict and (bad := failed.first()):
        raise CallFailed(f"document {bad['doc_id']}, batch {bad['batch_idx']}, pages {bad['pages']}, words {bad['w0']} to {bad['w1']}: no answer in {max_retries + 1} attempts")
    keys = F.struct("batch_idx", "ord", "path", "w0").alias("item")
    tag = F.when(F.size("category_ids") > 0, F.lit("llm")).otherwise(F.lit("instruction"))
    # The words that an item has of each of its pages.
    limit = F.coalesce(F.col("w1") - F.col("w0"), F.lit(1 << 30))
    answers = kept.where("answered").select(F.struct("doc_id", keys, tag.alias("tag")).alias("doc_id"), "payload", "pages", F.transform("sizes", lambda n: F.least(n, limit)).alias("sizes"))
    parsed = parse_own_pages(answers, F.lit(""))
    flat = parsed.select("doc_id.*", "page", "word_start", "word_end", "kind", "confidence", "seq").withColumnRenamed("tag", "source")
    moved = translate(flat.withColumn("slice_start", F.col("item.w0"))).select("doc_id", F.col("item.batch_idx").alias("batch_idx"), F.col("item.ord").alias("ord"), F.col("item.path").alias("path"), "page", "word_start", "word_end", "kind", "confidence", "source", "seq")
    ordered = moved.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("batch_idx", "ord", "path", "seq")).cast("long"))
    whole, halved = ordered.where("path = ''"), ordered.where("path <> ''")
    return whole.drop("path").unionByName(dedupe(halved.drop("path"), ("doc_id", "batch_idx", "ord"))), calls, failed
