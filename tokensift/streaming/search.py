"""Token search over Structured Streaming.

The predicates keep no state, so a tree of them filters a stream as it filters a table.  Postings of arriving rows are
appended as they come; a batch read of the folder groups them into an index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokensift.functions.analyzer import analyze
from tokensift.operators.index import InvertedIndex
from tokensift.operators.search import Predicate, as_condition


def matching(stream: DataFrame, text_column: str, tree: Predicate, non_ascii: str = "error") -> DataFrame:
    """The rows of ``stream`` for which ``tree`` is true."""
    return stream.where(as_condition(tree, text_column, non_ascii))


def token_counts(stream: DataFrame, time_column: str, text_column: str, window: str, late: str, non_ascii: str = "error") -> DataFrame:
    """``start, term, n_rows``: rows that contain each term, by tumbling window of ``time_column``; rows later than ``late``
    are left out, which bounds the state."""
    timed = stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, late)
    terms = timed.select(time_column, F.explode(F.array_distinct(analyze(text_column, non_ascii))).alias("term"))
    counts = terms.groupBy(F.window(time_column, window).alias("w"), "term").agg(F.count("*").alias("n_rows"))
    return counts.select(F.col("w.start").alias("start"), "term", "n_rows")


def append_postings(stream: DataFrame, id_column: str, text_column: str, row_group_size: int, path: str, checkpoint: str, non_ascii: str = "error") -> StreamingQuery:
    """Write ``row_group, term, row_id`` of all available rows of ``stream`` below ``path``; the query ends by itself."""
    postings = stream.select(F.col(id_column).cast("bigint").alias("row_id"), F.explode(F.array_distinct(analyze(text_column, non_ascii))).alias("term"))
    grouped = postings.select(F.expr(f"row_id div {row_group_size}").alias("row_group"), "term", "row_id")
    return grouped.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def streamed_index(spark: SparkSession, path: str, row_group_size: int) -> InvertedIndex:
    """The index of all postings that streams have appended below ``path`` so far; batches written twice count once."""
    postings = spark.read.schema("row_group bigint, term string, row_id bigint").parquet(path)
    grouped = postings.groupBy("row_group", "term").agg(F.sort_array(F.collect_set("row_id")).alias("row_ids"))
    return InvertedIndex(grouped.withColumn("postings_count", F.size("row_ids").cast("bigint")), row_group_size)
