from pathlib import Path

from tokensift.sources.tables import _remove, laid_out, materialized, shared_dir, table, work_path


def test_table_reads_only_what_is_asked_for(spark):
    df = table(spark, "/root/testdata/sf0.001", "logs", "row_id", "message")
    assert df.columns == ["row_id", "message"]
    plan = df.where("message IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<row_id:bigint,message:string>" in plan and "IsNotNull(message)" in plan
    assert "component" in table(spark, "/root/testdata/sf0.001", "logs").columns


def test_materialized_ends_the_lineage(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS r", "CAST(NULL AS STRING) AS s").groupBy("r").count()
    kept = materialized(df, "kept")
    assert kept.schema == df.schema or [f.name for f in kept.schema] == [f.name for f in df.schema]
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_work_goes_with_the_application(spark):
    path = Path(work_path(spark, "some").removeprefix("file://"))
    materialized(spark.range(1), "one")
    assert spark.sparkContext.applicationId in str(path) and path.parent.exists()
    _remove(spark, f"file://{path.parent}")
    assert not path.parent.exists()


def test_laid_out_rows_are_pruned(spark, tmp_path):
    df = laid_out(spark.range(10_000).selectExpr("id", "uuid() AS text").orderBy("text"), "id", 500, str(tmp_path / "rows"))
    plan = df.where("id >= 500 AND id < 1000")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,500)" in plan
    assert df.count() == 10_000 and df.where("id >= 500 AND id < 1000").count() == 500
