"""Most frequent values of a column in bounded memory: Misra-Gries summaries, merged.

A summary holds at most ``counters`` values with a count each.  Every task reduces its rows to one summary; summaries
merge by adding the counts and, where more than ``counters`` values are left, subtracting the next-largest count (the
``counters + 1``-th) from all and dropping what is not above zero.  With n rows in all, each count is too small by at
most n / (counters + 1), so every value with more rows than that is in the final summary, whatever the number of
distinct values, the order of rows or the shape of the merge tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokensift.llm.shipping import ship

SUMMARY = "value string, n bigint, error bigint, total bigint"
_ARROW = pa.schema([("value", pa.string()), ("n", pa.int64()), ("error", pa.int64()), ("total", pa.int64())])


class MisraGries:
    """One summary: counts that are too small by at most ``error``, over ``total`` rows."""

    def __init__(self, counters: int):
        if counters < 1:
            raise ValueError("counters must be at least 1")
        self.counters, self.counts, self.error, self.total = counters, {}, 0, 0

    def add(self, values: Iterable[str], counts: Iterable[int]) -> None:
        own = self.counts
        for value, n in zip(values, counts):
            own[value] = own.get(value, 0) + n
            self.total += n
        self._shrink()

    def merge(self, values: Iterable[str], counts: Iterable[int], error: int, total: int) -> None:
        self.error += error
        before = self.total + total
        self.add(values, counts)
        self.total = before

    def _shrink(self) -> None:
        if len(self.counts) > self.counters:
            cut = sorted(self.counts.values(), reverse=True)[self.counters]
            self.counts = {v: n - cut for v, n in self.counts.items() if n > cut}
            self.error += cut

    def rows(self) -> pa.RecordBatch:
        """The counts; a first row without value carries error and total."""
        k = len(self.counts)
        return pa.RecordBatch.from_arrays([
            pa.array([None, *self.counts], pa.string()), pa.array([0, *self.counts.values()], pa.int64()),
            pa.array([self.error] + [0] * k, pa.int64()), pa.array([self.total] + [0] * k, pa.int64()),
        ], schema=_ARROW)


def summarize(df: DataFrame, column: str, counters: int = 1024, fan_in: int = 16) -> DataFrame:
    """One Misra-Gries summary of the whole ``column``: ``value, n, error, total``.

    The row with a null value carries ``error`` and ``total``.  Summaries are merged in levels with a shuffle before each:
    a task gets those of ``fan_in`` tasks, at most ``fan_in * (counters + 1)`` rows, however many tasks the column takes; the
    number of levels is the logarithm of that.  It is read from the plan, so a ``df`` that must be shuffled itself is
    shuffled for that too.  Nulls are not counted; an empty column gives error 0 and total 0.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MisraGries(counters)
        for batch in batches:
            found = pc.value_counts(batch.column(0).drop_null())
            if len(found):
                own.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        yield own.rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MisraGries(counters)
        for batch in batches:
            heads = pc.is_null(batch.column("value"))
            head, rest = batch.filter(heads), batch.filter(pc.invert(heads))
            own.merge(rest.column("value").to_pylist(), rest.column("n").to_pylist(), pc.sum(head.column("error")).as_py() or 0, pc.sum(head.column("total")).as_py() or 0)
        yield own.rows()

    ship(df.sparkSession)
    values = df.select(F.col(column).cast("string").alias("value"))
    summaries, tasks = values.mapInArrow(scan, SUMMARY), max(1, values._jdf.queryExecution().toRdd().getNumPartitions())
    while True:
        tasks = -(-tasks // fan_in)
        # neighbours merge: task i of a level goes to task i div fan_in of the next
        part = F.floor(F.spark_partition_id() / fan_in).cast("int")
        summaries = summaries.withColumn("part", part).repartitionById(tasks, "part").drop("part").mapInArrow(merge, SUMMARY)
        if tasks == 1:
            return summaries


def _bounded(df: DataFrame, column: str, counters: int):
    """The summary's head, and its at most ``counters`` rows as a local table."""
    rows = summarize(df, column, counters).collect()  # at most counters + 1 rows
    head = next((r.asDict() for r in rows if r["value"] is None), {"error": 0, "total": 0})  # a plan known to be empty has no task
    return head, df.sparkSession.createDataFrame([tuple(r) for r in rows if r["value"] is not None], SUMMARY)


def bounds(df: DataFrame, column: str, counters: int = 1024) -> DataFrame:
    """``value, at_least, at_most``: bounds of the count of every value that the summary holds, at most ``counters``.

    Every value with more than total / (counters + 1) rows is there.
    """
    head, rest = _bounded(df, column, counters)
    return rest.select("value", F.col("n").alias("at_least"), (F.col("n") + F.lit(head["error"])).alias("at_most"))


def _counted(df: DataFrame, column: str, proposed: DataFrame) -> DataFrame:
    """``value, n``: exact counts of the proposed values, whose number is bounded; every task sends a row for each at most."""
    values = df.select(F.col(column).cast("string").alias("value"))
    return values.join(F.broadcast(proposed.select("value")), "value", "left_semi").groupBy("value").agg(F.count("*").alias("n"))


def frequent_values(df: DataFrame, column: str, share: int = 1024) -> DataFrame:
    """``value, n``: every value with more than 1/``share`` of the rows that are not null, with its exact count.

    A summary of ``share`` counters cannot miss one; a counting pass over its values decides.
    """
    head, proposed = _bounded(df, column, share)
    return _counted(df, column, proposed).where(F.col("n") * F.lit(share) > F.lit(head["total"]))


def top_values(df: DataFrame, column: str, k: int, counters: int = 1024, most: int = 65_536) -> DataFrame:
    """``value, n``: the ``k`` most frequent values with exact counts; of equal counts the smaller value comes first.

    The summary proposes and a counting pass over its values decides.  A value that the summary misses has at most ``error``
    rows: if the k-th count is above that, or nothing was ever subtracted, the answer is proven.  If it is not, that count
    tells how many counters prove it, and with these, if they are no more than ``most``, both passes are made once more.
    Counts flatter than that give no value an edge that bounded memory could see: then all values are counted by hash
    aggregation, spilled and distributed, and the ``k`` first are taken.  No more than max(counters, most) values leave
    the tasks for the driver.
    """
    while True:
        head, proposed = _bounded(df, column, counters)
        rows = _counted(df, column, proposed).orderBy(F.desc("n"), "value").limit(k).collect()
        last = rows[-1]["n"] if len(rows) == k else 0
        if head["error"] == 0 or last > head["error"]:
            break
        # total / (counters + 1) is below the k-th count so far, which can only be too small
        needed = head["total"] // last + 1 if last else most
        if not counters < needed <= most:
            exact = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
            rows = exact.orderBy(F.desc("n"), "value").limit(k).collect()
            break
        counters = needed
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], "value string, n bigint")
