"""Operators on literal rows."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroudline.functions import text as tx
from shroudline.operators import backups, costs, covers, planning, providers, redaction, replay, rules, selection
from shroudline.operators import findings as fnd
from shroudline.plans import run as plan
from shroudline.sources import audit, corpus, pricing, rulepacks

PACK = rulepacks.load("pii")


@pytest.fixture
def pages_of(spark):
    def make(*texts, page_words=400):
        return corpus.paginate(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", F.col("t"), page_words)

    return make


# ---- pages ----


def test_words_have_indexes_blocks_and_pages(pages_of):
    rows = {(r["doc_id"], r["page"]): [(w["idx"], w["text"], w["block_id"]) for w in r["words"]] for r in pages_of("a b\n\tc  d\n\n e", "", None, page_words=3).collect()}
    assert rows == {(0, 1): [(0, "a", 0), (1, "b", 0), (2, "c", 1)], (0, 2): [(0, "d", 1), (1, "e", 3)]}


def test_slices_are_numbered_anew(pages_of):
    row = pages_of("a b c d e").select(selection.slice_words(F.col("words"), F.lit(1), F.lit(4)).alias("w")).first()
    assert [(w["idx"], w["text"], w["x0"]) for w in row["w"]] == [(0, "b", 40.0), (1, "c", 80.0), (2, "d", 120.0)]


# ---- rules ----


def brute_findings(text):
    words = text.split()
    joined = " ".join(words)
    place = []
    for i, w in enumerate(words):
        place += [i - 1] * (i > 0) + [i] * len(w)
    out = []
    for c in PACK.categories:
        if c.detection == "regex":
            out += [(c.id, place[m.start()], place[max(m.end() - 1, m.start())]) for m in re.finditer(c.pattern, joined)]
    return out


def test_findings_equal_the_patterns(pages_of):
    texts = [
        "mail ann@ex.com, or bob.b@mail7.example.org!", "ssn 123-45-6789 and 987-65-4321.", "call +1 (743) 555-3824 or 743-555-3824 or (743) 555-3824", "iban DE89 3704 0044 0532 0130 00 end",
        "é123-45-6789 x123-45-6789 ١٢٣-٤٥-٦٧٨٩", "a@b.c a@b.cd @b.cd a@.cd a@b..cd", "1 2 3 555 555 5555 5555555555 55555555555", "🙂 🙂 a@bc.de 🙂", "nothing here",
    ]
    rows = rules.regex_findings(pages_of(*texts), PACK).orderBy("doc_id", "seq").collect()
    got = {k: [(r["kind"], r["word_start"], r["word_end"]) for r in rows if r["doc_id"] == k] for k in range(len(texts))}
    assert got == {k: brute_findings(t) for k, t in enumerate(texts)}
    assert {r["source"] for r in rows} == {"rules:pii-en"} and {r["confidence"] for r in rows} == {"high", "medium"}


@pytest.mark.parametrize(
    "pattern, literal",
    [
        (r"abc", "abc"), (r"\babcd\b", "abcd"), (r"a+bcd", "bcd"), (r"abcd?ef", "abc"), (r"abc|d", None), (r"(?:abc|def)ghi", "ghi"), (r"[abc]xyz[^]]uvwxy", "uvwxy"), (r"a\.b\.c", "a.b.c"), (r"(?i)abcdef", None),
        (r"\d{3}-\d{2}", None), (r"abc{2}def", "abc"), (r"abc{0,2}def", "def"), (r"abc*defg", "defg"), (r"x(a(b)[)]c)yzyz", "yzyz"), (r"(?<!\S)kking(?:s|ly)?(?!\S)", "kking"), (r"ab", None), (r"abc+?defg", "defg"), (r"\(tel\)", "(tel)"),
    ],
)
def test_literals_that_matches_must_hold(pattern, literal):
    assert rules.required_literal(pattern) == literal


def test_many_patterns_give_what_few_give(spark, pages_of, monkeypatch):
    texts = ["mail a@bc.de or 123-45-6789 or b@cd.ef", "call +1 (743) 555-3824 or 743-555-3824, iban DE89 3704 0044 0532 0130 00 end", "abc xabcx  abcabc 🙂 abc", "", "no match"]
    more = tuple(rulepacks.Category(f"c{i}", "c", "regex", "low", p) for i, p in enumerate([r"abc", r"\w*abc\w*", r"a b|c", r"or \d+", r"zzz+", r"(?:x|y)abc"]))
    pack = rulepacks.RulePack("p", "p", "p", 1, (*PACK.categories, *more))
    few = sorted(map(tuple, rules.regex_findings(pages_of(*texts), pack).collect()))
    monkeypatch.setattr(rules, "MANY", 1)
    assert sorted(map(tuple, rules.regex_findings(pages_of(*texts), pack).collect())) == few and len(few) > 10


def test_hundreds_of_patterns_cost_little_more_than_a_few():
    import random
    import time

    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60_000))
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    cats = [(i, rulepacks.Category(w, w, "regex", "low", rf"\b{w}(?:s|ly)?\b")) for i, w in enumerate(words)]

    def seconds(some):
        index = rules.PatternIndex(some)
        began = time.process_time()
        for _ in range(3):
            found = index.found(text)
        return time.process_time() - began, found

    few, many = seconds(cats[:4]), seconds(cats)
    assert len(many[1]) > len(few[1]) and len(rules.PatternIndex(cats).chosen(text[:300])) < 5
    whole = [(m.start(), i) for i, c in cats for m in re.finditer(c.pattern, text)]
    assert len(many[1]) == len(whole)
    short = text[:3000]  # a page: few of the literals are there
    a, b = rules.PatternIndex(cats[:4]), rules.PatternIndex(cats)
    timed = []
    for index in (a, b):
        began = time.process_time()
        for k in range(200):
            index.found(short)
        timed.append(time.process_time() - began)
    assert timed[1] < 3 * timed[0] + 0.05


def test_packs():
    assert rulepacks.load("pii") is rulepacks.load("pii-en")
    with pytest.raises(KeyError):
        rulepacks.load("none")
    pack = rulepacks.from_json('{"name": "n", "display_name": "", "description": "", "version": 2, "categories": [{"id": "a", "label": "A", "detection": "llm", "confidence": "low", "model": "m"}]}')
    assert pack.categories[0].model == "m"
    with pytest.raises(KeyError):
        rulepacks.from_json('{"name": "n"}')
    with pytest.raises(ValueError):
        rulepacks.Category("a", "A", "guess", "low")


# ---- findings ----

FINDING = "doc_id long, page int, word_start int, word_end int, kind string, confidence string, source string, seq long"


def test_dedupe(spark):
    rows = [(1, 1, 0, 2, "a", "low", "s", 0), (1, 1, 0, 2, "b", "low", "s", 1), (1, 1, 0, 2, "a", "high", "t", 2), (1, 1, 0, 2, "a", "high", "u", 3), (1, 1, 1, 2, "a", "odd", "s", 4), (1, 1, 1, 2, "a", "low", "v", 5)]
    got = fnd.dedupe(spark.createDataFrame(rows, FINDING)).orderBy("seq").collect()
    assert [(r["kind"], r["word_start"], r["confidence"], r["source"], r["seq"]) for r in got] == [("a", 0, "high", "t", 0), ("b", 0, "low", "s", 1), ("a", 1, "low", "v", 4)]


def test_payloads(spark):
    items = [
        '{"page": 1, "start": 0, "end": 1, "kind": "k", "confidence": "high"}', '{"page": "1", "start": 2.7, "end": "3", "kind": "k"}', '{"page": 1, "start": true, "end": 2, "kind": "k", "confidence": "sure"}',
        '{"page": 2, "start": 0, "end": 0, "kind": "k"}', '{"page": 1, "start": 3, "end": 2, "kind": "k"}', '{"page": 1, "start": 0, "end": 5, "kind": "k"}', '{"page": 1, "start": -1, "end": 2, "kind": "k"}', '{"page": 1, "end": 2, "kind": "k"}', '{"page": 1, "start": "x", "end": 2, "kind": "k"}',
    ]
    answers = spark.createDataFrame([(7, f'{{"findings": [{", ".join(items)}]}}'), (8, "no json"), (9, "{}")], "doc_id long, payload string")
    sizes = spark.createDataFrame([(7, 1, 5), (8, 1, 5)], "doc_id long, page int, n_words int")
    got = fnd.parse_payloads(answers, sizes, F.lit("llm")).orderBy("seq").collect()
    assert [(r["doc_id"], r["word_start"], r["word_end"], r["confidence"], r["seq"]) for r in got] == [(7, 0, 1, "high", 0), (7, 2, 3, "medium", 1), (7, 1, 2, "medium", 2)]


def test_boxes_and_context(spark, pages_of):
    pages = pages_of(" ".join(f"w{i}" for i in range(60)))
    found = spark.createDataFrame([(0, 1, 20, 21, "k", "low", "s", 0), (0, 1, 0, 0, "k", "low", "s", 1), (0, 1, 59, 99, "k", "low", "s", 2)], FINDING)
    rows = fnd.with_words(found, pages).orderBy("seq").select(fnd.text_of(fnd.covered()).alias("t"), fnd.context().alias("c"), fnd.finding_box().alias("b")).collect()
    assert rows[0]["t"] == "w20 w21" and rows[0]["c"].split() == [f"w{i}" for i in range(4, 38)]
    assert (rows[0]["b"]["x0"], rows[0]["b"]["y0"], rows[0]["b"]["x1"], rows[0]["b"]["y1"]) == (800.0, -1.5, 855.0, 10.5)
    assert rows[1]["c"].split() == [f"w{i}" for i in range(17)] and rows[2]["b"] is None and rows[2]["t"] == "w59"


# ---- selections, texts ----


@pytest.mark.parametrize(("spec", "pages"), [("1", [1]), (" 3 , 1-2 ", [1, 2, 3]), ("5-5,5", [5]), ("2-4,3", [2, 3, 4])])
def test_selection(spark, spec, pages):
    assert selection.parse(spec) == pages
    assert spark.range(1).select(selection.expand(F.lit(spec)).alias("p")).first()["p"] == pages


@pytest.mark.parametrize("spec", ["", " ", "1,", "0", "-3", "3-", "4-2", "a", "1-b", "1,,2"])
def test_bad_selection(spec):
    with pytest.raises(selection.SelectionError):
        selection.parse(spec)


def test_ranges_and_range_check(spark):
    got = spark.createDataFrame([([1, 2, 3, 7, 9, 10],), ([],), ([4],)], "p array<int>").select(tx.page_ranges(F.col("p")).alias("r")).collect()
    assert [r["r"] for r in got] == ["1-3, 7, 9-10", "", "4"]
    with pytest.raises(selection.SelectionError, match="3-4"):
        selection.require_in_range(spark.createDataFrame([(1, "1-4")], "doc_id long, spec string"), spark.createDataFrame([(1, 2)], "doc_id long, total_pages int"))


CASES = [
    ("1. a\n2. b", ["1. a", "2. b"]), ("hello\n1. a\n 2. b\n3. \n", ["1. a", "2. b\n3."]), ("- a\n* b", ["- a", "* b"]), ("1. only\n- x\n- y", ["- x", "- y"]), ("p one\n\n \np two\nmore", ["p one", "p two\nmore"]),
    ("see 1. and 2. inline", ["see 1. and 2. inline"]), ("  x  ", ["x"]), ("", [""]), ("1. a\n2. \n3. c", ["1. a", "3. c"]), ("- \n- a", ["- \n- a"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_instruction(spark, text, want):
    assert spark.range(1).select(tx.split_instruction(F.lit(text)).alias("r")).first()["r"] == want


@pytest.mark.parametrize(
    ("text", "want"), [("```json\n{}\n```", "{}"), ("  ```\na\nb```  ", "a\nb"), ("{}", "{}"), ("```json\n{}", "```json\n{}"), ("x ```\n{}\n```", "x ```\n{}\n```"), ("```\n\n```", "")]
)
def test_code_fence(spark, text, want):
    assert spark.range(1).select(tx.strip_code_fence(F.lit(text)).alias("r")).first()["r"] == want


def test_blocks_open_anew(pages_of, spark):
    pages = pages_of("a b\nc").withColumn("words", F.concat("words", F.array(F.struct(F.lit(3).alias("idx"), F.lit("d").alias("text"), F.lit(0).alias("block_id"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")]))))
    row = pages.select(tx.serialize_blocks(F.col("page"), F.col("words")).alias("s"), tx.serialize_flat(F.col("page"), F.col("words")).alias("f")).first()
    assert row["s"] == '<page n="1">\n<block id="0">[0]a [1]b</block>\n<block id="1">[2]c</block>\n<block id="0">[3]d</block>\n</page>'
    assert row["f"] == '<page n="1">\n[0]a [1]b [2]c [3]d\n</page>'


def test_small_functions(spark):
    row = spark.range(1).select(
        tx.truncate(F.lit("abcdef"), 4).alias("t"), tx.truncate(F.lit("abc"), 4).alias("u"), tx.truncate(F.lit("abc"), 1).alias("v"), tx.count_tokens(F.lit("abcdefghi")).alias("n"),
        tx.retry_delays(F.lit(3), F.lit(0.5), F.lit(2.0)).alias("d"), tx.retry_delays(F.lit(0), F.lit(0.5), F.lit(2.0)).alias("e"), tx.first_set(F.lit(None).cast("string"), F.lit(""), F.lit("x")).alias("f"),
    ).first()
    assert tuple(row) == ("abc…", "abc", "…", 502, [0.5, 1.0, 2.0], [], "x")


# ---- plans of calls ----


def test_halves(spark):
    item = "doc_id long, path string, pages array<int>, w0 int, w1 int"
    rows = planning.halves(spark.createDataFrame([(1, "", [1], 0, 8000), (2, "L", [1], 100, 201), (3, "", [1], 0, 100), (4, "", [1, 2, 5], None, None)], item)).orderBy("doc_id", "path").collect()
    got = [(r["doc_id"], r["path"], r["pages"], r["w0"], r["w1"]) for r in rows]
    assert got == [(1, "L", [1], 0, 4050), (1, "R", [1], 3950, 8000), (2, "LL", [1], 100, 200), (2, "LR", [1], 101, 201), (4, "L", [1], None, None), (4, "R", [2, 5], None, None)]


def test_halve_tree_reaches_the_floor(spark):
    def tree(path, w0, w1):
        half = (w1 - w0) // 2 + 50
        below = tree(path + "L", w0, w0 + half) + tree(path + "R", w1 - half, w1) if w1 - w0 > 100 else []
        return [(path, w0, w1), *below]

    items = spark.createDataFrame([(1, "", [1], 0, 1000), (2, "", [1], 0, 116), (3, "", [1], 0, 100), (4, "", [1, 2, 5], None, None)], "doc_id long, path string, pages array<int>, w0 int, w1 int")
    got = sorted((r["doc_id"], r["path"], r["w0"], r["w1"]) for r in planning.halve_tree(items).where("doc_id < 4").collect())
    assert got == sorted((k, *node) for k, n in ((1, 1000), (2, 116), (3, 100)) for node in tree("", 0, n))
    assert sorted(r["path"] for r in planning.halve_tree(items).where("doc_id = 4").collect()) == ["", "L", "R", "RL", "RR"]


def test_submissions(spark):
    cats = spark.createDataFrame([(0, "a", "llm", None), (1, "b", "llm", "m"), (2, "c", "regex", None), (3, "d", "llm", None)], "ord int, id string, detection string, model string")
    rules_ = spark.createDataFrame([(0, "x")], "ord int, text string")
    got = planning.submissions(cats, rules_, "base").orderBy("ord").collect()
    assert [(r["model"], r["category_ids"], r["instructions"]) for r in got] == [("base", ["a", "d"], []), ("m", ["b"], []), ("base", [], ["x"])]
    assert planning.submissions(cats, rules_.limit(0), "base", active=["b"]).count() == 1
    with pytest.raises(ValueError):
        planning.batches(cats, 0)


def words_provider(limit):
    """Finds every word "secret" of a prompt of limit words or fewer; gives up on longer ones."""

    def provide(request):
        import json as j
        import re as r

        found, n = [], 0
        for number, body in r.findall(r'<page n="(\d+)">\n(.*?)\n</page>', request.prompt, r.S):
            words = r.findall(r"\[(\d+)\](\S+)", body)
            n += len(words)
            found += [{"page": int(number), "start": int(i), "end": int(i), "kind": "s", "confidence": "low"} for i, w in words if w == "secret"]
        return None if n > limit else {"payload": j.dumps({"findings": found}), "tokens_in": n}

    return provide


def test_failed_items_are_halved_and_findings_moved(spark, pages_of):
    words = ["w"] * 900
    for i in (0, 449, 450, 460, 899):
        words[i] = "secret"
    pages = pages_of(" ".join(words), "secret x", "no", page_words=1000)
    subs = spark.createDataFrame([(0, "m", ["s"], [])], "ord int, model string, category_ids array<string>, instructions array<string>")
    found, calls, failed = providers.detect(pages, subs, words_provider(300), parallel=2)
    got = sorted((r["doc_id"], r["word_start"], r["word_end"], r["source"]) for r in found.collect())
    assert got == [(0, i, i, "llm") for i in (0, 449, 450, 460, 899)] + [(1, 0, 0, "llm")]
    assert calls.where("doc_id = 0").count() == 4 and failed.count() == 0
    with pytest.raises(providers.CallFailed):
        providers.detect(pages, subs, words_provider(10), parallel=2)
    _, _, failed = providers.detect(pages, subs, words_provider(10), parallel=2, strict=False)
    assert {r["doc_id"] for r in failed.collect()} == {0}


def test_what_the_last_round_loses_is_failed(spark, pages_of):
    pages = pages_of(" ".join(["w"] * 900), page_words=1000)
    subs = spark.createDataFrame([(0, "m", ["s"], [])], "ord int, model string, category_ids array<string>, instructions array<string>")
    _, _, failed = providers.detect(pages, subs, words_provider(300), parallel=2, max_levels=2, strict=False)
    assert sorted((r["path"], r["w0"], r["w1"]) for r in failed.collect()) == [("L", 0, 500), ("R", 400, 900)]
    with pytest.raises(providers.CallFailed):
        providers.detect(pages, subs, words_provider(300), parallel=2, max_levels=2)


def test_a_page_that_always_fails_is_halved_to_the_floor_and_reported(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: F.struct(i.cast("int").alias("idx"), F.lit("w").alias("text"), F.lit(0).alias("block_id"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")]))
    item = spark.range(1).select(F.lit(0).cast("long").alias("doc_id"), F.lit("").alias("path"), F.array(F.lit(1)).alias("pages"), F.lit(0).alias("w0"), F.size(words).alias("w1"))
    tree = planning.halve_tree(item.checkpoint())
    leaves = tree.where("w1 - w0 <= 100")
    assert tree.agg(F.max(F.length("path"))).first()[0] == 18 and leaves.count() > 2 * 200_000 / 100
    pages = spark.range(1).select(F.lit(0).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.slice(words, 1, 3000).alias("words"))
    subs = spark.createDataFrame([(0, "m", ["s"], [])], "ord int, model string, category_ids array<string>, instructions array<string>")
    _, calls, failed = providers.detect(pages, subs, lambda request: None, parallel=2, strict=False)
    covered = {w for r in failed.collect() for w in range(r["w0"], r["w1"])}
    assert covered == set(range(3000)) and calls.count() == 0


def test_providers_are_retried_with_waits_and_their_errors_are_no_answers(spark, pages_of, tmp_path):
    log = str(tmp_path / "calls")

    def flaky(request):
        import time

        with open(log, "a") as out:
            out.write(f"{time.time()} {request.attempt} {request.timeout} {request.seed} {request.model}\n")
        if request.attempt == 0:
            raise OSError("no connection")
        if request.attempt == 1:
            return None
        return {"payload": '{"findings": [{"page": 1, "start": 0, "end": 0, "kind": "s"}, {"page": 2, "start": 0, "end": 0, "kind": "s"}]}', "tokens_in": "12", "tokens_out": "many", "seed_honored": True}

    subs = spark.createDataFrame([(0, "m", ["s"], [])], "ord int, model string, category_ids array<string>, instructions array<string>")
    found, calls, failed = providers.detect(pages_of("a b\nc", "d"), subs, flaky, max_retries=2, backoff=0.2, parallel=1, seed=5, layout_aware=True)
    row = providers.call_records(calls, 5).orderBy("doc_id").first()
    assert (row["attempts"], row["tokens_in"], row["tokens_out"], row["seed_honored"], row["chunk_idx"], row["seed_requested"], list(row["page_word_range"])) == (3, 12, 0, True, 0, 5, [0, 3])
    assert len(row["prompt_sha256"]) == len(row["response_sha256"]) == 64 and failed.count() == 0
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 1]  # page 2 is none of these calls'
    lines = [x.split() for x in open(log).read().splitlines()]
    assert [x[1:] for x in lines] == [["0", "120.0", "5", "m"], ["1", "240.0", "5", "m"], ["2", "360.0", "5", "m"]] * 2
    assert float(lines[1][0]) - float(lines[0][0]) >= 0.2 and float(lines[2][0]) - float(lines[1][0]) >= 0.4
    assert providers.waits(3, 1.0, 2.0) == [1.0, 2.0, 4.0]
    prompt = providers.with_prompts(providers.work_items(pages_of("a b\nc"), 1, subs), pages_of("a b\nc"), layout_aware=True).first()
    assert '<block id="1">[2]c</block>' in prompt["document"] and prompt["prefix"].startswith("Categories: s")


SUBS = "ord int, model string, category_ids array<string>, instructions array<string>"


def test_tasks_make_the_prompts_that_sql_makes(spark, pages_of):
    pages = pages_of("a b\nc  d\n\ne", "x", page_words=3).withColumn("words", F.when(F.col("doc_id") == 1, F.transform("words", lambda w: w)).otherwise(F.col("words")))
    subs = spark.createDataFrame([(0, "m", ["s"], []), (1, "n", [], ["find"])], SUBS)
    for size in (1, 2):
        items = providers.work_items(pages, size, subs)
        for layout in (False, True):
            want = {(r["doc_id"], r["batch_idx"], r["ord"]): (r["prefix"], r["document"]) for r in providers.with_prompts(items, pages, layout).collect()}
            got = {(r["doc_id"], r["batch_idx"], r["ord"]): (r["prefix"], providers.document(r["contents"], layout_aware=layout)) for r in providers.with_contents(items, pages).collect()}
            assert got == want
    cut = items.where("size(pages) = 1 AND ord = 0").withColumns({"w0": F.lit(1), "w1": F.lit(3)})
    assert [r["document"] for r in providers.with_prompts(cut, pages).where("doc_id = 0").collect()] == [providers.document(r["contents"], 1, 3) for r in providers.with_contents(cut, pages).where("doc_id = 0").collect()]


def shuffled(spark, make):
    """Bytes that the stages of make() write to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        rows = sc.statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (rows.apply(i) for i in range(rows.size()))}

    before = stages()
    make()
    return sum(n for k, n in stages().items() if k not in before)


def test_texts_are_shuffled_once_whatever_the_number_of_submissions(spark, pages_of):
    """Disk: a batch goes to its task once, not once for each submission, and only with its texts."""
    pages = pages_of(*[" ".join(f"w{d * 7919 + i * 104729 % 99991}" for i in range(1200)) for d in range(40)])
    of = lambda n: spark.createDataFrame([(i, "m", [f"s{i}"], []) for i in range(n)], SUBS)
    answer = lambda request: {"payload": '{"findings": []}'}
    one, many = (shuffled(spark, lambda: providers.detect(pages, of(n), answer, pages_per_batch=3, parallel=2)[1].count()) for n in (1, 8))
    n_chars = pages.select(F.sum(F.length(corpus.page_text(F.col("words"))))).first()[0]
    assert 0 < one < 3 * n_chars and many < 1.2 * one


def test_a_batch_is_asked_as_its_prompt_and_key_say(spark, pages_of):
    """Whatever the words hold: the task's documents are those of with_contents, the key hashes all that is asked, and every submission asks for every batch."""

    def provide(request):
        import hashlib as h
        import json as j

        assert request.key == h.sha256(j.dumps([request.system, request.prompt, request.model, request.seed]).encode()).hexdigest()
        return {"payload": '{"findings": [{"page": 2, "start": 1, "end": 1, "kind": "k"}]}', "system_fingerprint": request.document}

    pages = pages_of("a b\nc \x1f d\x1fe\n\nf 🙂 \"g\" é", "x", "\x1f", page_words=3).withColumn("words", F.when(F.col("doc_id") == 1, F.slice("words", 1, 0)).otherwise(F.col("words")))
    subs = spark.createDataFrame([(0, "m", ["s"], []), (1, "n", [], ["f\u00fcnd \"it\""])], SUBS)
    for layout in (False, True):
        for size in (1, 2):
            items = providers.with_contents(providers.work_items(pages, size, subs), pages)
            want = {(r["doc_id"], r["batch_idx"], r["ord"]): providers.document(r["contents"], layout_aware=layout) for r in items.collect()}
            found, calls, _ = providers.detect(pages, subs, provide, pages_per_batch=size, parallel=2, seed=3, layout_aware=layout)
            rows = calls.collect()
            assert {(r["doc_id"], r["batch_idx"], r["ord"]): r["system_fingerprint"] for r in rows} == want and len(rows) == len(want)
            assert {(r["ord"], r["model"], tuple(r["category_ids"]), tuple(r["instructions"])) for r in rows} == {(0, "m", ("s",), ()), (1, "n", (), ('f\u00fcnd "it"',))}
            # Only page 2 has a second word, and only the call that has the page may name it.
            assert sorted((r["doc_id"], r["batch_idx"], r["ord"], r["page"], r["source"]) for r in found.collect()) == [(0, 1 if size == 1 else 0, o, 2, s) for o, s in ((0, "llm"), (1, "instruction"))]


def test_parts_are_halved_as_the_plan_halves_items(spark):
    for n_pages, n in ((1, 1), (1, 101), (1, 777), (5, 230), (2, 90)):
        item = spark.createDataFrame([(0, "", list(range(1, n_pages + 1)), 0 if n_pages == 1 else None, n if n_pages == 1 else None)], "doc_id long, path string, pages array<int>, w0 int, w1 int")
        want, level = set(), item
        sizes = F.lit(n)
        while True:
            single = F.size("pages") == 1
            level = planning.halves(level).withColumns({"w0": F.when(single, F.coalesce("w0", F.lit(0))), "w1": F.when(single, F.coalesce("w1", sizes))})
            rows = level.collect()
            if not rows:
                break
            want |= {(r["path"], tuple(r["pages"]), r["w0"], r["w1"]) for r in rows}
            level = spark.createDataFrame(rows, level.schema)
        got, todo = set(), [providers.Part("", 0, n_pages, *((0, n) if n_pages == 1 else (None, None)))]
        while todo:
            new = todo.pop().halves([n] * n_pages)
            todo += new
            got |= {(p.path, tuple(range(p.first + 1, p.last + 1)), p.w0, p.w1) for p in new}
        assert got == want


def test_a_task_that_is_killed_half_way_makes_no_call_twice(spark, pages_of, tmp_path):
    log, alive = str(tmp_path / "calls"), str(tmp_path / "alive")

    def provide(request):
        import os

        lines = open(log).read().split() if os.path.exists(log) else []
        if len(lines) == 6 and not os.path.exists(alive):
            open(alive, "w").close()
            os._exit(1)  # in the middle of a document whose first half is answered
        with open(log, "a") as out:
            out.write(request.key + "\n")
        return None if request.document.count(" ") > 200 else {"payload": '{"findings": []}', "tokens_in": 1}

    pages = pages_of(*[" ".join(f"w{d}-{i}" for i in range(300)) for d in range(8)])
    subs = spark.createDataFrame([(0, "m", ["s"], [])], SUBS)
    store = str(tmp_path / "store")
    with pytest.raises(Exception):  # noqa: B017
        providers.detect(pages, subs, provide, parallel=1, store=store)
    _, calls, failed = providers.detect(pages, subs, provide, parallel=1, store=store)
    asked = open(log).read().split()
    assert calls.count() == 16 and failed.count() == 0
    # Answers are kept, and so is nothing else: what was not answered is asked again by another run.
    answered = {r for r in asked if providers.AnswerStore(store).get(r)["answer"] is not None}
    assert len(answered) == 16 and all(asked.count(k) == 1 for k in answered)
    # Within a run, what failed isn't asked again either.
    again = providers.AnswerStore(store)
    assert all(again.get(k)["attempts"] == 1 for k in set(asked))
    before = len(asked)
    providers.detect(pages, subs, provide, parallel=2, store=store)
    assert {k for k in open(log).read().split()[before:]} & answered == set()


def test_registry():
    @providers.register("mine")
    def make(model, size=1):
        return lambda request: {"payload": f"{model}{size}"}

    assert providers.make_provider("mine", "m", size=3)(providers.Request("")) == {"payload": "m3"}
    with pytest.raises(ValueError, match="nobody"):
        providers.make_provider("nobody", "m")


def test_batches_of_pages_are_halved_by_pages(spark, pages_of):
    pages = pages_of(" ".join(["secret"] * 50), page_words=10)
    subs = spark.createDataFrame([(0, "m", [], ["find it"])], "ord int, model string, category_ids array<string>, instructions array<string>")
    found, calls, _ = providers.detect(pages, subs, words_provider(20), pages_per_batch=5, parallel=2)
    assert sorted((r["page"], r["word_start"], r["source"]) for r in found.collect()) == [(p, i, "instruction") for p in range(1, 6) for i in range(10)]
    assert sorted(r["pages"] for r in calls.collect()) == [[1, 2], [3], [4, 5]]


# ---- costs ----


def test_costs(spark):
    # 56 calls of 4200 tokens in and 400 out; the first writes 1180 tokens to the cache, the others read them.
    calls = spark.createDataFrame([("hosted", "large", 4200, 400, 1180 if i == 0 else 0, 0 if i == 0 else 1180) for i in range(56)], "provider string, model string, tokens_in long, tokens_out long, cache_creation_input_tokens long, cache_read_input_tokens long")
    cost = costs.actual(pricing.require_rates(pricing.with_rates(calls, pricing.sample(spark))), ["provider"]).first()["cost_usd"]
    assert abs(cost - 5.327) < 0.01
    with pytest.raises(KeyError):
        pricing.require_rates(pricing.with_rates(calls.withColumn("model", F.lit("none")), pricing.sample(spark)))


def test_price_file(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"providers": {"a": {"m": {"input_per_million": 1, "output_per_million": 2}, "*": {"input_per_million": 3, "output_per_million": 4, "cache_read_multiplier": 0}}}}')
    got = sorted(tuple(r) for r in pricing.load(spark, str(path)).collect())
    assert got == [("a", "*", 3.0, 4.0, 1.25, 0.0), ("a", "m", 1.0, 2.0, 1.25, 0.1)]


# ---- redaction and verification ----


def test_redact_diff_and_render(spark, pages_of):
    pages = pages_of("a b c d e", "x <y>")
    found = spark.createDataFrame([(0, 1, 1, 2, "k", "low", "s", 0), (0, 1, 2, 3, "k", "low", "s", 1), (1, 1, 1, 1, "k", "low", "s", 0)], FINDING)
    out = redaction.redact(pages, found)
    assert {r["doc_id"]: [w["text"] for w in r["words"]] for r in out.collect()} == {0: ["a", "e"], 1: ["x"]}
    assert {r["doc_id"]: r["text"] for r in redaction.redacted_text(pages, found, "#").collect()} == {0: "a # # # e", 1: "x #"}
    diff = redaction.page_diff(pages, out)
    assert {r["doc_id"]: r["removed"] for r in diff.collect()} == {0: ["b", "c", "d"], 1: ["<y>"]}
    assert redaction.render_text(diff).orderBy("doc_id").first()["line"] == "page 1: 3 removed: b, c, d"
    assert '"removed":["b","c","d"]' in redaction.render_json(diff).orderBy("doc_id").first()["line"]
    assert "<td>&lt;y&gt;</td>" in redaction.render_html(diff).where("doc_id = 1").first()["html"]
    with pytest.raises(ValueError, match="page count"):
        redaction.require_same_pages(pages, out.where("doc_id = 0"))


def test_many_rectangles_and_ranges_give_what_few_give(spark, pages_of, monkeypatch):
    pages = pages_of(" ".join(f"w{i}" if i % 9 else "." for i in range(300)), "\n".join(["a b c d"] * 30))
    # Small and wide ones, some of them tall, empty or thin.
    rect = lambda i: F.struct(i.cast("long").alias("rect_id"), (i * 37 % 400 * 30.0).alias("x0"), (i * 13 % 30 * 12.0).alias("y0"), (i * 37 % 400 * 30.0 + F.when(i % 3 == 0, 9000.0).otherwise(i % 5 * 50.0)).alias("x1"), (i * 13 % 30 * 12.0 + F.when(i % 4 == 0, 300.0).otherwise(i % 2 * 11.0)).alias("y1"), F.array(F.lit(0.1)).alias("fill"))
    span = lambda i: F.struct((i * 53 % 310).cast("int").alias("word_start"), (i * 53 % 310 + i % 6 - 1).cast("int").alias("word_end"))
    full = pages.withColumns({"rects": F.transform(F.sequence(F.lit(0), F.lit(199)), rect), "found": F.transform(F.sequence(F.lit(0), F.lit(59)), span)})

    def all_of():
        leaks = sorted(map(tuple, redaction.found_leaks(full).select("doc_id", "page", "rect_id", "recovered_text").collect()))
        left = [[w["idx"] for w in r["words"]] for r in redaction.redact_found(full).orderBy("doc_id").collect()]
        return leaks, left, sorted(map(tuple, redaction.text_found(full).collect())), sorted(map(str, redaction.diff_found(full).collect()))

    many = all_of()
    assert len(many[0]) > 20 and 0 < len(many[1][0]) < 250
    monkeypatch.setattr(redaction, "FEW", 1000)
    assert many == all_of()


def test_searches_in_batches_give_what_spark_gives_and_cost_less(spark, pages_of, monkeypatch):
    """Odd boxes and fills, and pages with few rectangles among pages with many; the searches of a batch take less than half the time of Spark's expressions."""
    import random
    import time

    rng = random.Random(5)
    some = lambda *odd: rng.choice([*odd, *[float(rng.randrange(0, 60)) for _ in range(20)]])

    def box(wide, high):
        x0, y0 = some(None, -0.5), some(None, -0.5)
        return {"x0": x0, "y0": y0, "x1": None if x0 is None else x0 + rng.choice(wide), "y1": None if y0 is None else y0 + rng.choice(high)}

    fills = [[0.1, 0.2, 0.3], [0.1, 0.2, 0.3, 0.9], [0.1, None], [0.1], [], None, [0.1, 0.5, 0.1], [float("nan")], [0.0, 0.0, 0.0, None]]
    word = lambda i: {"idx": i // 2 * 2, "text": rng.choice(["a", "b", ".", "", None, "é"]), "block_id": 0, **box([0, 1, 4.5], [0, 2, 6])}
    rect = lambda i: {"rect_id": rng.choice([i, i, None]), **box([0, 20, 40.5], [0, 5, 4.999, 30]), "fill": rng.choice(fills)}
    rows = [(d, 1, [word(i) for i in range(rng.choice([0, 1, 40, 80, 120]))], [rect(i) for i in range(n)]) for d, n in enumerate([0, 3, 16, 17, 60, 90] * 8)]
    odd = spark.createDataFrame(rows, f"doc_id long, page int, words {corpus.WORDS_TYPE}, rects {redaction.RECTS}")
    got = lambda: sorted(map(str, redaction.found_leaks(odd).collect()))
    many = got()
    with monkeypatch.context() as m:
        m.setattr(redaction, "FEW", 1000)
        assert many == got() and len(many) > 50
        boxes = lambda items: tuple(np.array([w[c] for w in items if w["x0"] is not None and w["y0"] is not None], float) for c in ("x0", "y0", "x1", "y1"))
        pairs = lambda r: [p for found in covers._page(boxes(r[2]), boxes(r[3]), 1.0) for p in zip(*map(list, found))]
        whole = list(map(pairs, rows))
        m.setattr(covers, "PAIRS", 7)
        assert whole == list(map(pairs, rows)) and any(whole)
    tile = lambda i: F.struct(i.cast("long").alias("rect_id"), (i % 50 * 320.0).alias("x0"), F.lit(0.0).alias("y0"), (i % 50 * 320.0 + 250).alias("x1"), F.lit(9.0).alias("y1"), F.array(F.lit(0.1)).alias("fill"))
    tiled = pages_of(*[" ".join(f"w{i}" for i in range(400))] * 1200).withColumn("rects", F.transform(F.sequence(F.lit(0), F.lit(199)), tile)).checkpoint()
    took = []
    for leaks in (redaction.found_leaks, lambda pages: redaction.seen_leaks(pages.select("doc_id", "page", redaction.covered_texts().alias("seen")))):
        began = time.monotonic()
        assert leaks(tiled).agg(F.sum(F.length("recovered_text"))).first()[0] > 0
        took.append(time.monotonic() - began)
    assert took[0] < took[1] / 2


def test_a_page_with_very_many_rectangles_is_quick(spark, pages_of):
    import time

    pages = pages_of(" ".join(f"w{i}" for i in range(400)))
    rect = lambda i: F.struct(i.cast("long").alias("rect_id"), (i % 16000 * 1.0).alias("x0"), F.lit(0.0).alias("y0"), (i % 16000 * 1.0 + 60).alias("x1"), F.lit(9.0).alias("y1"), F.array(F.lit(0.1)).alias("fill"))
    began = time.monotonic()
    n = redaction.found_leaks(pages.withColumn("rects", F.transform(F.sequence(F.lit(0), F.lit(9999)), rect))).count()
    assert n > 9000 and time.monotonic() - began < 20


def test_differences_go_by_places_in_tenths_whatever_these_are(spark):
    """Against plain Python: ties, signs of zero, places that are no numbers, words that are there twice, versions in the row and in a table of their own."""
    import decimal
    import random

    rng, tenth = random.Random(3), decimal.Decimal("0.1")
    odd = [0.0, -0.0, 0.04, -0.04, 0.05, 0.15, 0.25, 0.35, -0.25, 0.1, 0.2, 40.0, 40.04, 39.96, 1e15, 1e15 + 0.5, 1e22, float("nan"), float("inf"), float("-inf"), None]
    word = lambda i: {"idx": i, "text": rng.choice(["a", "a", "b", "1 a", None]), "block_id": 0, "x0": rng.choice(odd), "y0": rng.choice(odd[:4]), "x1": 1.0, "y1": 2.0}

    def key(w):
        at = lambda v: None if v is None else str(v) if v != v or v in (float("inf"), float("-inf")) else str(float(decimal.Decimal(repr(v)).quantize(tenth, decimal.ROUND_HALF_EVEN, decimal.Context(prec=60))) + 0.0)
        return " ".join(x for x in (at(w["x0"]), at(w["y0"]), w["text"]) if x is not None)

    rows = []
    for d in range(60):
        words = [word(i) for i in range(rng.choice([0, 1, 5, 30]))]
        if d % 2:  # no key is there twice
            words = list({key(w): w for w in words}.values())
        after = None if d == 7 else words if d == 8 else [dict(w, x1=9.0) for w in words] if d == 9 else [dict(w, x0=rng.choice(odd) if rng.random() < 0.2 else w["x0"]) for w in words if rng.random() < 0.8]
        rows.append((d, 1, words, after))
    want = sorted((d, w["idx"]) for d, _, words, after in rows for w in words if key(w) not in set(map(key, after or [])))
    both = spark.createDataFrame(rows, f"doc_id long, page int, words {corpus.WORDS_TYPE}, after {corpus.WORDS_TYPE}")
    old, new = both.drop("after"), both.where("after IS NOT NULL").select("doc_id", "page", F.col("after").alias("words"))
    for gone in (redaction.removed_from(both), redaction.removed_words(old, new)):
        assert sorted((r["doc_id"], r["idx"]) for r in gone.collect()) == want and len(want) > 100
    sizes = {(r["doc_id"], len(r["removed"])) for r in redaction.page_diff(old, new).collect()}
    assert sizes == {(r["doc_id"], len(r["removed"])) for r in redaction.diff_of(both.where("after IS NOT NULL")).collect()} == {(d, sum(k == d for k, _ in want)) for d in range(60) if d != 7}


def test_differences_count_repeated_words(spark, pages_of):
    """A word that is twice at its place is lost twice or not at all; a page that is missing is lost whole."""
    at = lambda t, x: {"idx": 0, "text": t, "block_id": 0, "x0": x, "y0": 0.0, "x1": x + 5, "y1": 9.0}
    kind = pages_of("a").schema["words"].dataType.simpleString()
    make = lambda rows: spark.createDataFrame(rows, f"doc_id long, page int, words {kind}")
    old = make([(1, 1, [at("a", 1.0), at("a", 1.0), at("b", 2.0), at("b", 2.0), at("c", 3.0)]), (1, 2, [at("z", 1.0)])])
    new = make([(1, 1, [at("b", 2.04), at("c", 3.06), at("a", 9.0)])])
    assert sorted(r["text"] for r in redaction.removed_words(old, new).collect()) == ["a", "a", "c", "z"]
    assert redaction.page_diff(old, new).first()["removed"] == ["a", "a", "c"]


def test_overlays_and_metadata(spark, pages_of):
    pages = pages_of("abc def . ghi")
    rect = "doc_id long, page int, rect_id long, x0 double, y0 double, x1 double, y1 double, fill array<double>"
    rows = [
        (0, 1, 1, 0, 0, 60, 9, [0.0, 0.1, 0.2]), (0, 1, 2, 0, 0, 300, 9, [1.0, 1.0, 1.0]), (0, 1, 3, 0, 0, 300, 3, [0.0]), (0, 1, 4, 80, 0, 90, 9, [0.0]), (0, 1, 5, 0, 0, 300, 9, None), (0, 1, 6, 0, 0, 300, 9, []), (0, 1, 7, 119, 1, 135, 8, [0.4, 0.4, 0.4, 0.9]),
    ]
    leaks = redaction.overlay_leaks(pages, spark.createDataFrame([tuple(float(v) if 3 <= i < 7 else v for i, v in enumerate(r)) for r in rows], rect))
    assert sorted((r["rect_id"], r["recovered_text"]) for r in leaks.collect()) == [(1, "abc def"), (7, "ghi")]
    meta = redaction.metadata_leaks(spark.createDataFrame([(0, "author", " Ann "), (0, "title", " \t\n"), (0, "xmp", "x" * 300), (0, "color", "red")], "doc_id long, field string, value string"))
    assert sorted((len(r["recovered_text"]), r["detail"]) for r in meta.collect()) == [(3, "metadata field author holds 'Ann'"), (200, "the metadata stream is not empty")]
    cleared = redaction.clear_metadata(spark.createDataFrame([(0, "author", " Ann "), (0, "xmp", "x")], "doc_id long, field string, value string"))
    assert cleared.count() == 2 and redaction.metadata_leaks(cleared).count() == 0
    report = redaction.reports(pages, leaks.unionByName(meta)).first()
    assert (report["passed"], report["n_leaks"], report["summary"]) == (False, 4, "2 text_under_overlay, 2 metadata")
    assert redaction.reports(pages, meta.limit(0)).first()["summary"] == "nothing left"


# ---- audit, undo, backups ----


def test_run_audit_and_undo(spark, pages_of, tmp_path):
    pages = pages_of("mail a@bc.de or 123-45-6789 now", "clean text")
    result = plan.run(pages, plan.detect(pages, PACK), metadata=spark.createDataFrame([], "doc_id long, field string, value string"))
    assert {r["doc_id"]: r["passed"] for r in result.report.collect()} == {0: True, 1: True}
    assert {r["doc_id"]: [w["text"] for w in r["words"]] for r in result.pages.collect()} == {0: ["mail", "or", "now"], 1: ["clean", "text"]}
    path = str(tmp_path / "log")
    audit.export(result.events, path)
    events = audit.read(spark, path)
    assert [r["event"] for r in events.orderBy("line_no").collect()] == ["session_start", "finding", "finding", "session_end"]
    many = str(tmp_path / "logs")
    more = plan.run(pages_of(*["mail a@bc.de"] * 30), PACK).events
    audit.write(more, many, buckets=4)
    audit.write(result.events.withColumn("session_id", F.lit(77).cast("long")), many, buckets=4)
    back = audit.read_written(spark, many)
    assert back.select("session_key").distinct().count() == 31 and len(list((tmp_path / "logs").glob("bucket=*"))) <= 4
    assert [r["event"] for r in back.where("session_key = '77'").orderBy("line_no").collect()] == ["session_start", "finding", "finding", "session_end"]
    assert replay.applied(back).count() == 32
    keyed = events.withColumn("session_key", F.lit("0"))
    assert audit.sessions(keyed).first()["input_path"] == "doc:0"
    back = plan.undo(pages, keyed, kind="email").first()
    assert [w["text"] for w in back["words"]] == ["mail", "a@bc.de", "or", "now"]
    assert len(plan.undo(pages, keyed).first()["words"]) == 5
    found = replay.applied(keyed)
    assert replay.exclusions(found, words=(1, 1)).count() == 1 and replay.exclusions(found).count() == 0 and replay.exclusions(found, page=2, kind="email").count() == 0
    assert replay.undo_events(found, replay.exclusions(found, page=1)).count() == 2
    # Metadata are cleared, and the output is judged.
    meta = spark.createDataFrame([(0, "author", "Ann"), (0, "title", "T"), (1, "xmp", "x")], "doc_id long, field string, value string")
    cleared = plan.run(pages, PACK, metadata=meta)
    assert {r["doc_id"]: r["passed"] for r in cleared.report.collect()} == {0: True, 1: True} and cleared.pages.count() == 2
    assert [r["value"] for r in cleared.metadata.collect()] == ["", "", ""]
    failed = plan.run(_covered(pages), PACK)
    assert {r["doc_id"] for r in failed.pages.collect()} == {1}
    assert '"status":"verify_failed"' in failed.events.orderBy(F.desc("ord")).first()["value"]


def _covered(pages, doc_id=0):
    """Pages with a dark rectangle over the first words of one document."""
    box = F.struct(F.lit(1).cast("long").alias("rect_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(60.0).alias("x1"), F.lit(9.5).alias("y1"), F.array(F.lit(0.0)).alias("fill"))
    return pages.withColumn("rects", F.when(F.col("doc_id") == doc_id, F.array(box)).otherwise(F.array().cast(redaction.RECTS)))


def test_lines_of_decomposition_calls_and_failure(spark, pages_of):
    pages = pages_of("mail a@bc.de", "clean")
    calls = spark.createDataFrame([(0, i, [1], 0.0, None, False, None, "p", "r", 100, 10, 7, None, 0, 0, 0.25) for i in range(2)], "doc_id long, chunk_idx int, pages array<int>, temperature double, seed_requested long, seed_honored boolean, system_fingerprint string, prompt_sha256 string, response_sha256 string, tokens_in long, tokens_out long, duration_ms long, page_word_range array<int>, cache_creation_input_tokens long, cache_read_input_tokens long, cost_usd double")
    told = spark.createDataFrame([("parser", "2 rules by form", ["a", "b"])], "source string, detail string, rules array<string>")
    result = plan.run(_covered(pages), PACK, calls=calls, decomposed=told, selection="1", provider="stub", model="m", instructions=("a", "b"), include_text=True)
    lines = [json.loads(r["value"]) for r in result.events.where("session_id = 0").orderBy("ord").collect()]
    assert [x["event"] for x in lines] == ["session_start", "instruction_decomposed", "chunk_request", "chunk_request", "finding", "verification_failed", "session_end"]
    start, told, first, _, found, wrong, end = lines
    assert wrong["leaks"] == [{"page": 1, "kind": "text_under_overlay", "detail": "text can be read under a dark rectangle"}]
    assert (start["pages_spec"], start["pages_resolved"], start["rules"], start["instructions"], start["input_pages"], start["input_bytes"]) == ("1", [1], ["pii-en"], ["a", "b"], 1, 12)
    assert told["rule_count"] == 2 and first["seed_requested"] is None and first["chunk_idx"] == 0
    assert (found["text"], found["context"], found["bbox"]) == ("a@bc.de", "mail a@bc.de", [40.0, 0.0, 75.0, 9.0])
    assert (end["status"], end["tokens_in"], end["tokens_out"], end["duration_ms"], end["cost_usd"], end["verify_leak_count"], end["output_sha256"]) == ("verify_failed", 200, 20, 14, 0.5, 1, "")
    assert result.events.where("session_id = 1").count() == 0


def test_a_run_searches_each_page_once_for_its_record(spark, pages_of):
    pages = pages_of("mail a@bc.de or 123-45-6789 now", "clean text")
    result = plan.run(pages, PACK)
    for df in (result.findings, result.events, result.report, plan.undo_lines(_keyed(result.events), kind="email")):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in text and "RegExpExtractAll" not in text and "rlike" not in text.lower()
    undone = plan.undo(pages, _keyed(result.events), kind="email")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in undone.split("LogicalRDD")[0].lower() or undone.count("phone") == 0


def _keyed(events):
    return audit.parse_lines(events.select(F.col("session_id").cast("string").alias("session_key"), F.col("ord").alias("line_no"), "value"))


def test_undo_lines_and_texts(spark, pages_of):
    pages = pages_of("mail a@bc.de or 123-45-6789 now", "clean text", "x@yz.org")
    log = _keyed(plan.run(pages, PACK).events)
    counts = spark.createDataFrame([("0", 1, 1), ("2", 0, 0)], "session_key string, n_overlays long, n_metadata long")
    copies = spark.createDataFrame([("0", "/b/0")], "session_dir string, copy_path string")
    lines = {}
    for r in plan.undo_lines(log, copies, counts=counts, kind="email").orderBy("ord").collect():
        lines.setdefault(r["session_key"], []).append(json.loads(r["value"]))
    assert set(lines) == {"0", "2"} and [x["event"] for x in lines["0"]] == ["undo_start", "undo_finding", "undo_end"]
    start, found, end = lines["0"]
    assert (start["backup_path"], start["findings_total"], start["findings_excluded"], start["selector"]["kind"], start["source_session_id"]) == ("/b/0", 2, 1, "email", "0")
    assert len(found["text_sha256"]) == len(found["context_sha256"]) == 64
    assert (end["status"], end["redactions_kept"], end["redactions_un_redacted"], end["verify_result"], end["verify_leak_count"]) == ("verify_failed", 1, 1, "fail", 2)
    assert lines["2"][0]["backup_path"] is None and lines["2"][-1]["verify_result"] == "pass"
    texts = {(r["session_key"], r["ordinal"]): r["text"] for r in replay.texts(replay.applied(log), pages.where("doc_id = 0")).collect()}
    assert texts == {("0", 0): "a@bc.de", ("0", 1): "123-45-6789", ("2", 0): ""}
    assert replay.parse_words("3-7") == (3, 7) and replay.parse_words(None) is None
    for bad in ("3", "a-b", "3-", ""):
        with pytest.raises(ValueError):
            replay.parse_words(bad)
    assert replay.page_choices(replay.applied(log), pages=[2]).count() == 0


def test_selectors_of_every_shape(spark, pages_of):
    pages = pages_of("mail a@bc.de or 123-45-6789", "x@yz.org", " ".join(["w"] * 400 + ["q@rs.tu"]), "call 743-555-3824")
    log = _keyed(plan.run(pages, PACK).events)
    found = replay.applied(log)
    rows = {(r["session_key"], r["ordinal"]): r for r in found.collect()}
    assert len(rows) == 5
    kind = "session_key string, page int, kind string, word_start int, word_end int"
    for selectors in (
        [], [(None, None, None, None, None)], [("0", None, None, None, None)], [(None, 2, None, None, None)], [(None, None, "email", None, None), ("3", 1, "phone_us", None, None)],
        [(None, None, None, 1, 1)], [("0", 1, "email", 1, 1), ("0", 2, None, None, None), ("9", None, None, None, None)], [("1", None, None, 0, 0), ("1", None, None, 0, 0)], [(None, None, None, 1, None), ("2", None, None, None, None)],
    ):
        want = {k for k, r in rows.items() if any(all(a is None or a == r[c] for c, a in zip(("session_key", "page", "kind"), s)) and (s[3] is None or s[4] is None or s[3:] == (r["word_start"], r["word_end"])) for s in selectors)}
        got = replay.exclusions_of(found, spark.createDataFrame(selectors, kind))
        assert {(r["session_key"], r["ordinal"]) for r in got.collect()} == want and got.count() == len(want)
    some = spark.createDataFrame([("0", None, "email", None, None), ("1", None, None, None, None)], kind)
    back = {r["doc_id"]: [w["text"] for w in r["words"]] for r in plan.undo(pages, log, selectors=some).where("page = 1").collect()}
    assert back[0] == ["mail", "a@bc.de", "or"] and back[1] == ["x@yz.org"] and back[3] == ["call"]
    assert sorted(r["session_key"] for r in plan.undo_lines(log, selectors=some).where("ord < 0").collect()) == ["0", "1"]


def test_bad_logs(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.log").write_text('{"event": "session_start", "session_id": "1"}\n\n{oops\n')
    with pytest.raises(ValueError, match="line 3"):
        audit.read(spark, str(tmp_path / "a"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.log").write_text('{"event": "finding", "decision": "applied", "new_field": 1}\n')
    with pytest.raises(ValueError, match="session_start"):
        audit.read(spark, str(tmp_path / "b"))


def test_backups(spark, tmp_path):
    for name in ("2026-01-02T03-04-05Z-abc123", "2026-01-03T00-00-00Z", "odd"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(f'{{"timestamp": "{name}", "original_path": "/d/a", "copy_path": "/b/{name}"}}')
    rows = audit.read_backups(spark, str(tmp_path)).where("session_dir <> 'odd'")
    assert backups.latest(rows).first()["session_dir"] == "2026-01-03T00-00-00Z"
    everything, now = audit.read_backups(spark, str(tmp_path)), F.lit("2026-01-03 05:00:00").cast("timestamp")
    ages = {r["session_dir"]: r["a"] for r in everything.select("session_dir", backups.age_label(F.col("ts"), now).alias("a")).collect()}
    assert ages == {"2026-01-02T03-04-05Z-abc123": "25 hours old", "2026-01-03T00-00-00Z": "5 hours old", "odd": "of unknown age"}
    assert [r["session_dir"] for r in backups.expired(everything, 24, now).collect()] == ["2026-01-02T03-04-05Z-abc123"]
    assert backups.expired(everything, 0, now).count() == 0
    assert backups.by_session(everything, "odd").count() == 1
    assert backups.latest_of(everything, "/d/a").first()["session_dir"] == "odd" and backups.latest_of(everything, "/d/b").count() == 0
    dirs = spark.createDataFrame([(r["session_dir"],) for r in rows.collect()], "session_dir string")
    assert backups.newest(rows, dirs).first()["session_dir"] == "2026-01-03T00-00-00Z"
    assert backups.newest(rows, dirs.union(spark.createDataFrame([("2026-02-01T00-00-00Z",)], "session_dir string"))).count() == 0
    logs = spark.createDataFrame([("odd", "s")], "session_key string, session_id string")
    assert {r["session_dir"]: r["session_id"] for r in backups.with_audit(everything, logs).collect()} == {"odd": "s", "2026-01-03T00-00-00Z": None, "2026-01-02T03-04-05Z-abc123": None}
    files = spark.createDataFrame([("r", "r.v2"), ("r", "r.v10"), ("r", "x.v99"), ("s", "s")], "base string, name string")
    assert {r["base"]: r["next_version"] for r in backups.next_versions(files).collect()} == {"r": 11, "s": 2}


def test_streaming_audit(spark, tmp_path):
    from shroudline.streaming.audit import findings_by_kind, read_stream

    (tmp_path / "in").mkdir()
    lines = [f'{{"event": "finding", "kind": "{k}", "ts": "2026-01-01T0{h}:10:00Z"}}' for k, h in (("a", 1), ("a", 1), ("b", 2))]
    (tmp_path / "in/x.log").write_text("\n".join([*lines, "oops", ""]))
    stream = findings_by_kind(read_stream(spark, str(tmp_path / "in")))
    done = stream.writeStream.outputMode("complete").format("memory").queryName("kinds").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert sorted((r["kind"], r["n"]) for r in spark.table("kinds").collect()) == [("a", 2), ("b", 1)]


def test_rows_of_pages_and_tables_of_findings_agree(spark, pages_of):
    pages = pages_of("mail a@bc.de or 123-45-6789 now a@bc.de", "clean text", "1 (743) 555-3824")
    in_rows, joined = plan.run(pages, PACK), plan.run(pages, plan.detect(pages, PACK), rule_names=(PACK.name,))
    for name in ("findings", "pages", "report", "events"):
        a, b = (sorted(map(str, getattr(r, name).collect())) for r in (in_rows, joined))
        assert a == b
    diff = redaction.removed_words(pages, joined.pages).groupBy("doc_id").agg(F.count("*").alias("n"))
    sizes = redaction.page_diff(pages, in_rows.pages).select("doc_id", F.size("removed").alias("n")).where("n > 0")
    assert {tuple(r) for r in diff.collect()} == {tuple(r) for r in sizes.collect()}
    both = [redaction.diff_found(rules.annotate(pages, PACK)), redaction.page_diff(pages, in_rows.pages)]
    assert len({tuple(sorted(map(str, d.select("doc_id", "page", "before_text", "after_text", "removed").collect()))) for d in both}) == 1
    plain = redaction.text_found(rules.annotate(pages, PACK)).collect()
    assert sorted(map(str, plain)) == sorted(map(str, redaction.redacted_text(pages, plan.detect(pages, PACK)).collect()))
