"""Every query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from shroudline import catalog

from .test_operators import shuffled

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v.tolist() if hasattr(v, "tolist") else v)
    return sorted(tuple(show(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sql):
    ours = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(ours) > 0
        return
    theirs = sql.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert [str(t) for t in ours[sorted(ours.columns)].dtypes] == [str(t) for t in theirs[sorted(theirs.columns)].dtypes]
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name, times", [("diff_versions", 2), ("model_call_records", 5), ("diff_lines", 2), ("diff_removed_words", 2)])
def test_what_is_shuffled_is_bounded_by_the_table(spark, name, times):
    """Disk: versions of a page are compared in its row, and calls get texts only. Dealing out the small table is counted."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # so small a table would be broadcast
    try:
        written = shuffled(spark, lambda: catalog.QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written < times * os.path.getsize(f"{DATA}/documents.parquet")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_run_reads_the_metadata_that_it_clears(spark, sql, tmp_path):
    """Metadata of the input don't fail a document, but a run counts them, and its SQL does."""
    ours = {r["doc_id"]: r for r in catalog.QUERIES["run_rules"](spark, DATA).collect()}
    held = {}
    for r in catalog.QUERIES["metadata_leaks"](spark, DATA).collect():
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + 1
    assert {k: r["n_cleared"] for k, r in ours.items()} == {k: held.get(k, 0) for k in ours} and any(r["n_cleared"] and r["passed"] and r["n_words"] for r in ours.values())
    # Texts of white space of any kind as metadata, nulls and ids that repeat: the same as the SQL.
    docs = [(0, " \u00a0\u2003\n", "a"), (7, "\u00a0\x0b\x85", "\u3000"), (14, "\u00a0 x", None), (21, None, "a"), (35, "mail a@bc.de", "s"), (35, "mail a@bc.de", "s"), (70, "", " ")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = catalog.QUERIES["run_rules"](spark, str(tmp_path)).select("doc_id", "n_cleared").toPandas(), con.sql(catalog.ORACLE_SQL["run_rules"]).df()[["doc_id", "n_cleared"]]
    assert rows(got) == rows(want) and len(got) > 2
