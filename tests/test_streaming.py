from pyspark.sql import functions as F

from tokensift.operators.index import build_index
from tokensift.operators.search import Token, search
from tokensift.streaming import append_postings, matching, streamed_index, token_counts

EVENTS = "/root/testdata/sf0.001/events.parquet"


def stream(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("m", F.concat("event_type", F.lit(" "), "props"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_matching_rows(spark, tmp_path):
    batch, arriving = stream(spark, tmp_path)
    q = matching(arriving, "m", Token("ERROR") | Token("view")).select("event_id").writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.event_id for r in matching(batch, "m", Token("error") | Token("view")).collect()}
    assert {r.event_id for r in spark.table("hits").collect()} == want and want


def test_postings_of_a_stream(spark, tmp_path):
    batch, arriving = stream(spark, tmp_path)
    append_postings(arriving, "event_id", "m", 256, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    grouped = spark.read.parquet(str(tmp_path / "out")).groupBy("row_group", "term").agg(F.sort_array(F.collect_set("row_id")).alias("row_ids"))
    want = build_index(batch, "event_id", "m", 256).select("row_group", "term", "row_ids")
    assert grouped.exceptAll(want).count() == want.exceptAll(grouped).count() == 0
    index = streamed_index(spark, str(tmp_path / "out"), 256)
    assert index.violations().count() == 0 and index.lookup("error").count() == search(batch, "event_id", "m", Token("error")).count()
    assert sorted(r.event_id for r in search(batch, "event_id", "m", ~Token("error"), index, path="join").collect()) == sorted(r.event_id for r in search(batch, "event_id", "m", ~Token("error")).collect())


def test_windowed_counts(spark, tmp_path):
    batch, arriving = stream(spark, tmp_path)
    q = token_counts(arriving, "ts", "event_type", "1 hour", "3650 days").writeStream.format("memory").outputMode("complete").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.term): r.n_rows for r in spark.table("counts").collect()}
    want = batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), F.lower("event_type").alias("term")).count()
    assert got == {(r.w.start, r.term): r["count"] for r in want.collect()}
