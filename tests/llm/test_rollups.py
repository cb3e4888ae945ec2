import itertools
import random

from shroudline.llm.rollups import RollupStore

EVENT = "doc_id long, op string, source string, lang string, version string, tokens long, seq int"


def totals(store):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}


def test_batches_keep_the_totals(spark, tmp_path):
    rng, store, truth = random.Random(1), RollupStore(spark, str(tmp_path / "s")), {}
    assert totals(store) == {}
    for batch in range(1, 5):
        events = []
        for doc in rng.sample(range(30), 15):
            op = rng.choice(("insert", "revise", "delete"))
            row = (doc, op, rng.choice(("a", "b", None)), rng.choice(("en", None)), "v1", rng.randint(0, 50), 0)
            events.append(row)
            truth.pop(doc, None)
            if op != "delete":
                truth[doc] = row
        frame = spark.createDataFrame(events, EVENT)
        assert store.commit(batch, frame)
        before = totals(store)
        assert not store.commit(batch, frame)  # sent again
        want = {}
        for row in truth.values():
            n, t = want.get((row[2], row[3], row[4]), (0, 0))
            want[(row[2], row[3], row[4])] = (n + 1, t + row[5])
        assert totals(store) == before == want
    assert store.batches() == [1, 2, 3, 4]


def test_a_broken_attempt_is_written_over(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "s"))
    store.commit(1, spark.createDataFrame([(1, "insert", "a", "en", "v", 5, 0)], EVENT))
    spark.createDataFrame([("a", "en", "v", 99, 99)], "source string, lang string, version string, docs long, tokens long").write.parquet(str(tmp_path / "s/deltas/2-broken"))
    assert totals(store) == {("a", "en", "v"): (1, 5)}
    assert store.commit(2, spark.createDataFrame([(1, "revise", "b", "en", "v", 7, 0)], EVENT))
    assert totals(store) == {("b", "en", "v"): (1, 7)}


def test_odd_events(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "s"))
    rows = [(None, "insert", "a", "en", "v", 5, 0), (1, "insert", "a", "en", None, 5, 0), (2, "rename", "a", "en", "v", 5, 0), (3, "insert", None, None, "v", None, 0), (4, "delete", "a", "en", "v", 1, 0), (5, "insert", "a", "en", "v", 5, 1), (5, "insert", "a", "en", "v", 9, 2), (6, "revise", "a", "en", "v", 1, None)]
    store.commit(1, spark.createDataFrame(rows, EVENT))
    assert totals(store) == {(None, None, "v"): (1, 0) if totals(store)[(None, None, "v")][1] == 0 else (1, None), ("a", "en", "v"): (2, 10)}
    store.commit(2, spark.createDataFrame([], EVENT))
    assert totals(store)[("a", "en", "v")] == (2, 10)


def random_batches(rng, n, docs=12):
    return {b: [(doc, rng.choice(("insert", "revise", "delete")), rng.choice(("a", "b", None)), "en", "v1", rng.randint(0, 50), 0) for doc in rng.sample(range(docs), 6)] for b in range(1, n + 1)}


def want_of(batches):
    truth, want = {}, {}
    for _, events in sorted(batches.items()):
        for row in events:
            truth.pop(row[0], None)
            if row[1] != "delete":
                truth[row[0]] = row
    for row in truth.values():
        n, t = want.get((row[2], row[3], row[4]), (0, 0))
        want[(row[2], row[3], row[4])] = (n + 1, t + row[5])
    return want


def test_batches_in_any_order_give_the_same_totals(spark, tmp_path):
    rng = random.Random(3)
    batches = random_batches(rng, 3)
    for k, order in enumerate(rng.sample(list(itertools.permutations(batches)), 3)):
        store = RollupStore(spark, str(tmp_path / f"s{k}"), snapshot_every=2)
        seen = {}
        for b in order:
            assert store.commit(b, spark.createDataFrame(batches[b], EVENT))
            seen[b] = batches[b]
            assert totals(store) == want_of(seen)
        assert store.batches() == [1, 2, 3] and not store.commit(2, spark.createDataFrame(batches[2], EVENT))
        live = {(r["doc_id"], r["tokens"]) for r in store.ledger().collect()}
        assert sum(t for _, t in live) == sum(t for _, t in want_of(seen).values())


def test_snapshots_keep_totals_and_bound_the_plan(spark, tmp_path):
    batches = random_batches(random.Random(4), 7)
    store, sizes = RollupStore(spark, str(tmp_path / "s"), snapshot_every=3), []
    for b, events in batches.items():
        store.commit(b, spark.createDataFrame(events, EVENT))
        sizes.append((len(store._log()[2]), store.totals()._jdf.queryExecution().optimizedPlan().toString().count("\n")))
    assert totals(store) == want_of(batches)
    assert max(n for n, _ in sizes) <= 4 and len({lines for _, lines in sizes}) == 1


def test_a_writer_that_loses_the_race_counts_anew(spark, tmp_path):
    batches = random_batches(random.Random(5), 3)
    store, other = (RollupStore(spark, str(tmp_path / "s")) for _ in range(2))
    frames = {b: spark.createDataFrame(e, EVENT) for b, e in batches.items()}
    store.commit(1, frames[1])
    append, raced = store._append, []

    def late(number, entry):
        if not raced:
            raced.append(other.commit(3, frames[3]))
        return append(number, entry)

    store._append = late
    assert store.commit(2, frames[2]) and raced == [True]
    assert totals(store) == want_of(batches)
    raced.clear()
    store._append = late
    assert not other.commit(3, frames[3]) and store.batches() == [1, 2, 3]


def test_pieces_of_a_tokenizer_are_a_version_like_any_other(spark, make_docs, tmp_path):
    from shroudline.llm import pieces
    from shroudline.llm.rollups import piece_counts

    from .conftest import ODD

    store = RollupStore(spark, str(tmp_path / "s"))
    assert store.commit(1, piece_counts(make_docs([*ODD, (None, "no id")])))
    model = pieces._chunks(None).model
    assert totals(store) == {("src0", "en", "piece-32k"): (len(ODD), sum(len(model.encode(t or "", add_eos=True)) for t in ODD))}
    store.remove()
    assert store.batches() == []


def folders(path, name):
    return sorted(p.name for p in (path / "s" / name).iterdir() if p.is_dir())


def test_superseded_tables_and_those_of_lost_attempts_go(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "s"), snapshot_every=4)
    event = lambda k: spark.createDataFrame([(k % 5, "insert", "a", "en", "v", k, 0)], EVENT)
    event(1).select("doc_id").write.parquet(str(tmp_path / "s/ledger/7-lost"))
    for k in range(1, 13):
        assert store.commit(k, event(k))
    before, kept = totals(store), folders(tmp_path, "ledger")
    assert len(kept) > 12 and store.vacuum() == 0  # nothing is old enough
    under_way = store.totals()  # lists the newest tables
    gone = store.vacuum(grace_seconds=0)
    left = folders(tmp_path, "ledger")
    assert gone > 0 and len(left) < 10 and "7-lost" not in left and len(folders(tmp_path, "deltas")) == len(left)
    assert totals(store) == before == {("a", "en", "v"): (5, sum(range(8, 13)))}
    assert under_way.count() == 1
    assert store.commit(13, event(13)) and not store.commit(5, event(5)) and store.commit(0, event(99))
    assert totals(store) == {("a", "en", "v"): (5, 9 + 10 + 11 + 12 + 13)}
    assert store.vacuum(keep=0, grace_seconds=0) > 0 and totals(store) == {("a", "en", "v"): (5, 55)}


def test_few_and_many_ids_give_the_same(spark, tmp_path, monkeypatch):
    from shroudline.llm import rollups

    def run(name):
        rng, store = random.Random(3), RollupStore(spark, str(tmp_path / name))
        for batch in rng.sample(range(1, 5), 4):
            store.commit(batch, spark.createDataFrame([(rng.randrange(20), rng.choice(rollups.OPERATIONS), rng.choice("ab"), "en", rng.choice("vw"), rng.randint(1, 9), 0) for _ in range(12)], EVENT))
        return totals(store)

    few = run("few")
    monkeypatch.setattr(rollups, "FEW_IDS", 0)
    assert few == run("many") and few
