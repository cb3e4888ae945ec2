"""Sources and sinks that are files, settings, and instructions for a model."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from shroudline.operators import redaction, rules
from shroudline.plans import config, instructions
from shroudline.sources import audit, files, pricing, rulepacks, sinks


def test_extract_selects_and_recognizes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two\nthree\fsecond page\fthird")
    loaded = files.read_files(spark, str(tmp_path), "*.txt")
    pages = files.extract(loaded, files.plain_text, selection=[1, 3]).orderBy("page").collect()
    assert [(r["page"], [(w["idx"], w["text"], w["block_id"]) for w in r["words"]]) for r in pages] == [(1, [(0, "one", 0), (1, "two", 0), (2, "three", 1)]), (3, [(0, "third", 0)])]

    def scanned(content, wanted):
        return [(1, ["text"], False), (2, [], True)]

    def recognizer(content, wanted):
        return [(n, ["seen"], True) for n in wanted]

    assert {r["page"]: [w["text"] for w in r["words"]] for r in files.extract(loaded, scanned, recognizer=recognizer).collect()} == {1: ["text"], 2: ["seen"]}
    with pytest.raises(files.RecognitionRequired):
        files.require_recognized(files.extract(loaded, scanned), None)
    found = rules.regex_findings(files.extract(files.read_files(spark, str(tmp_path)), files.plain_text).drop("has_image"), rulepacks.load("pii"))
    assert found.count() == 0


def test_publish_is_gated(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.range(3)
    leaks = redaction.metadata_leaks(spark.createDataFrame([(1, "author", "Ann")], "doc_id long, field string, value string"))
    with pytest.raises(sinks.VerificationFailed):
        sinks.publish(df, path, leaks)
    assert not list(tmp_path.glob("out*"))
    sinks.publish(df, path, leaks.limit(0))
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(sinks.OutputExists, match=r"out\.v2"):
        sinks.publish(df, path)
    (tmp_path / "out.v7").mkdir()
    assert sinks.free_name(spark, path).endswith("out.v8")
    sinks.publish(spark.range(5), path, overwrite=True)
    assert spark.read.parquet(path).count() == 5
    # A move that fails leaves what was there.
    fs = sinks.Files(spark, path)
    with pytest.raises(Exception):  # noqa: B017
        fs.replace(f"{path}-missing", path)
    assert spark.read.parquet(path).count() == 5 and not list(tmp_path.glob("out.old-*"))


def test_output_paths(spark, tmp_path):
    source = str(tmp_path / "in")
    assert sinks.output_path(spark, source) == f"{source}.redacted"
    (tmp_path / "in.redacted").mkdir()
    with pytest.raises(sinks.OutputExists):
        sinks.output_path(spark, source)
    assert sinks.output_path(spark, source, overwrite=True) == f"{source}.redacted"
    assert sinks.output_path(spark, source, versioned=True) == f"{source}.redacted.v2"
    for wrong in ({"output": f"{source}/"}, {"versioned": True, "overwrite": True}):
        with pytest.raises(ValueError):
            sinks.output_path(spark, source, **wrong)


def test_backups_are_made_and_swept(spark, tmp_path):
    source, root = str(tmp_path / "t"), str(tmp_path / "b")
    spark.range(4).write.parquet(source)
    old = sinks.create_backup(spark, source, root, datetime(2026, 1, 1, tzinfo=UTC))
    new = sinks.create_backup(spark, source, root, datetime(2026, 1, 9, tzinfo=UTC))
    (tmp_path / "b/mine").mkdir()
    rows = {r["session_dir"]: r for r in audit.read_backups(spark, root).collect()}
    assert set(rows) == {old, new} and spark.read.parquet(rows[new]["copy_path"]).count() == 4
    assert sinks.sweep_backups(spark, root, 0) == 0
    assert sinks.sweep_backups(spark, root, 48, datetime(2026, 1, 10, tzinfo=UTC)) == 1
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == sorted([new, "mine"])


def test_price_list_is_checked_before_it_is_taken(spark, tmp_path):
    good, bad, target = tmp_path / "g.json", tmp_path / "b.json", tmp_path / "t.json"
    good.write_text(json.dumps({"providers": {"a": {"*": {"input_per_million": 1, "output_per_million": 2}}}}))
    bad.write_text(json.dumps({"providers": {"a": {"*": {"input_per_million": 1}}}}))
    for _ in range(2):
        sinks.refresh_pricing(spark, str(good), str(target))
    with pytest.raises(ValueError):
        sinks.refresh_pricing(spark, str(bad), str(target))
    assert pricing.load(spark, str(target)).first()["cache_write_multiplier"] == 1.25
    assert pricing.resolve(spark, None, str(tmp_path / "none.json")).count() == len(pricing.SAMPLE)
    assert pricing.resolve(spark, None, str(target)).count() == 1 and pricing.resolve(spark, str(good)).count() == 1
    calls = spark.createDataFrame([("a", "m", 1, 2)], "provider string, model string, own long, other long")
    assert pricing.with_rates(calls, pricing.load(spark, str(target))).first()["input_per_million"] == 1.0


def test_settings(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('model = "m"\nmax_retries = 5\nlayout_aware = true\n')
    got, origin = config.resolve({"model": "", "pages_per_batch": 3}, {"SHROUDLINE_MAX_RETRIES": "1"}, str(path))
    assert (got.model, got.max_retries, got.pages_per_batch, got.layout_aware, got.provider) == ("m", 1, 3, True, "local")
    assert origin["model"] == "file" and origin["max_retries"] == "environment" and origin["pages_per_batch"] == "argument" and origin["provider"] == "default"
    config.write(got, str(path))
    assert config.resolve({}, {}, str(path))[0] == got
    for bad in ({"max_retries": -1}, {"max_retries": True}, {"retry_backoff_multiplier": 0.5}, {"pages_per_batch": "x"}, {"model": 3}, {"layout_aware": "maybe"}):
        with pytest.raises(config.ConfigError):
            config.resolve(bad, {})
    path.write_text("colour = 1\n")
    with pytest.raises(config.ConfigError):
        config.resolve({}, {}, str(path))


def test_long_instructions_go_to_the_splitter(spark):
    long = "remove names " * 40
    rows = spark.createDataFrame([(0, "1. a\n2. b"), (1, "short"), (2, long), (3, long + "x")], "ord int, text string")
    got = {r["ord"]: r for r in instructions.decompose(rows, lambda t: None if t.endswith("x") else ["one", "two"]).collect()}
    assert [(got[k]["source"], len(got[k]["rules"])) for k in range(4)] == [("parser", 2), ("original", 1), ("llm_fallback", 2), ("llm_fallback", 1)]
    assert got[3]["rules"] == [long + "x"]
    assert {r["source"] for r in instructions.decompose(rows).where(F.col("ord") > 0).collect()} == {"original"}
