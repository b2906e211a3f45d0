"""Work spread evenly: joins whose hot keys are split, and tables of few files over all cores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(rows: DataFrame, states: DataFrame, on: Sequence[str], weight: str, ways: int = 1024) -> DataFrame:
    """The inner join of ``rows`` with ``states``, which has one row for each key and its number of ``rows`` in ``weight``.

    A key with more than 1/``ways`` of all rows is split into as many parts as its share asks for; its state is repeated for
    each.  There are fewer than ``ways`` such keys, which is what is broadcast.  Null keys match nothing.  ``states`` is read
    three times: it should be a table.
    """
    total = states.agg(F.sum(weight).alias("n")).first()["n"] or 1
    parts = F.greatest(F.ceil(F.col(weight) * F.lit(ways / total)), F.lit(1)).cast("bigint")
    hot = states.where(parts > 1).select(*on, parts.alias("__parts"))
    salted = rows.join(F.broadcast(hot), list(on), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("__parts")), F.lit(0))).drop("__parts")
    copies = states.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return salted.join(copies, [*on, "__salt"]).drop("__salt")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files come in fewer parts than there are cores; for work that is heavy by row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
