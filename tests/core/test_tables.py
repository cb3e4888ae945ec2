from shroudline.functions import tables


def test_a_small_table_in_one_block_is_dealt_over_the_cores(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "none.parquet"))
    one, many, none = (tables.table(spark, str(tmp_path), n) for n in ("one", "many", "none"))
    assert "Repartition" in one._jdf.queryExecution().optimizedPlan().toString() and one.count() == 1000
    assert "Repartition" not in many._jdf.queryExecution().optimizedPlan().toString() and many.count() == 1000
    assert none.count() == 0
    # Columns and filters still reach the scan.
    plan = one.where("id > 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan
    monkeypatch.setattr(tables, "SMALL", 10)
    assert "Repartition" not in tables.table(spark, str(tmp_path), "one")._jdf.queryExecution().optimizedPlan().toString()


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "key int, KEY_ int")
    assert tables.fresh("key", df) == "key__" and tables.fresh("other", df) == "other"
