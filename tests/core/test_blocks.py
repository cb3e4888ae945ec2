"""Backups by the content of blocks."""

import hashlib
import random

import pytest

from shroudline.plans import run as plan
from shroudline.sources import blocks, rulepacks


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    same = rng.randbytes(2500)
    (source / "a.bin").write_bytes(same)
    (source / "deep" / "b.bin").write_bytes(same)  # a copy
    (source / "c.bin").write_bytes(same[:1000] + rng.randbytes(700))  # shares its first block
    (source / "empty.bin").write_bytes(b"")
    return source


def stored(tmp_path):
    return sum(1 for _ in (tmp_path / "store" / "blocks").glob("*.parquet"))


def test_a_second_backup_stores_nothing(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    name, n = blocks.create(spark, str(folder), store, block=1000)
    assert n == 3 + 1  # three of the first file, one more of the third
    assert spark.read.parquet(f"{store}/blocks").count() == n
    parts = stored(tmp_path)
    again, none = blocks.create(spark, str(folder), store, block=1000)
    assert none == 0 and stored(tmp_path) == parts and again != name and sorted([name, again]) == blocks.backups(spark, store)
    (folder / "c.bin").write_bytes((folder / "c.bin").read_bytes() + b"more")
    _, few = blocks.create(spark, str(folder), store, block=1000)
    assert few == 1
    out = tmp_path / "out"
    assert blocks.restore(spark, store, name, str(folder), str(out)) == 3
    got = {p.relative_to(out).as_posix(): p.read_bytes() for p in out.rglob("*.bin")}
    want = {p.relative_to(folder).as_posix(): p.read_bytes() for p in folder.rglob("[abc].bin")}
    want["c.bin"] = want["c.bin"][:-4]
    assert got == want


def test_hashes_are_of_bytes(spark, folder):
    rows = {r["path"].rsplit("/", 1)[1]: r for r in blocks.content_hashes(spark, str(folder), block=1000).collect()}
    for name in ("a.bin", "c.bin"):
        content = (folder / name).read_bytes()
        assert (rows[name]["sha256"], rows[name]["size"]) == (hashlib.sha256(content).hexdigest(), len(content))
        parts = [hashlib.sha256(content[i : i + 1000]).digest() for i in range(0, len(content), 1000)]
        root = parts[0] if len(parts) == 1 else hashlib.sha256(parts[0] + parts[1]).digest() if len(parts) == 2 else hashlib.sha256(hashlib.sha256(parts[0] + parts[1]).digest() + parts[2]).digest()
        assert (rows[name]["tree_sha256"], rows[name]["n_blocks"]) == (root.hex(), len(parts))
    assert rows["a.bin"]["tree_sha256"] == rows["b.bin"]["tree_sha256"] != rows["c.bin"]["tree_sha256"]


def test_a_run_records_the_hashes_of_the_files_it_read(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from shroudline.sources import files

    source = tmp_path / "in"
    source.mkdir()
    (source / "one.txt").write_text("mail a@bc.de now")
    loaded = files.read_files(spark, str(source))
    pages = files.extract(loaded, files.plain_text).select("doc_id", "page", "words")
    inputs = blocks.content_hashes(spark, str(source)).select(F.xxhash64("path").alias("doc_id"), "sha256", "size")
    start = next(x for x in (json.loads(r["value"]) for r in plan.run(pages, rulepacks.load("pii"), inputs=inputs).events.collect()) if x["event"] == "session_start")
    assert (start["input_sha256"], start["input_bytes"]) == (hashlib.sha256(b"mail a@bc.de now").hexdigest(), 16)


def test_damage_is_noticed(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    name, _ = blocks.create(spark, str(folder), store, block=1000)
    bad = spark.read.parquet(f"{store}/blocks")
    from pyspark.sql import functions as F

    bad.withColumn("content", F.lit(b"x")).write.parquet(str(tmp_path / "bad" / "blocks"))
    spark.read.parquet(f"{store}/backups/{name}").write.parquet(str(tmp_path / "bad" / "backups" / name))
    with pytest.raises(Exception, match="damaged"):
        blocks.restore(spark, str(tmp_path / "bad"), name, str(folder), str(tmp_path / "out"))
