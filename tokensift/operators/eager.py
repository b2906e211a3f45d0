"""Eager aggregation through joins: per-key totals that a few heavy keys cannot delay.

A join of two tables on a key of which some values hold a third of all rows repeats every pair of rows of such a value
in one task.  Where only counts and sums are wanted, the pairs are never needed: each input is first reduced to one
compact state per join key (map-side combine makes this cheap for heavy keys, as every task sends one row per key), the
states are joined one to one, and the algebra of the aggregate does the rest: the number of joined rows is the product
of the counts, a sum over one side is multiplied by the count of the other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_states: Mapping[str, Column],
    right_states: Mapping[str, Column],
    combine: Mapping[str, Column],
    rollup: Sequence[str],
    rollup_states: Mapping[str, Column],
    how: str = "inner",
) -> DataFrame:
    """Join states instead of rows, then roll up.

    ``left_states`` / ``right_states``: aggregates by ``on`` (names must differ); ``combine``: expressions over the joined
    states; ``rollup_states``: aggregates of the combined columns by ``rollup``, a subset of ``on``.

    Keys that are null never match, as in any equi-join; under an outer ``how`` they stay as rows of their own.
    An empty input gives an empty result for an inner join.  Columns other than those named are ignored.
    """
    clash = set(left_states) & set(right_states)
    if clash:
        raise ValueError(f"state names on both sides: {sorted(clash)}")
    a = left.groupBy(*on).agg(*(c.alias(n) for n, c in left_states.items()))
    b = right.groupBy(*on).agg(*(c.alias(n) for n, c in right_states.items()))
    joined = a.join(b, list(on), how).select(*on, *(c.alias(n) for n, c in combine.items()))
    return joined.groupBy(*rollup).agg(*(c.alias(n) for n, c in rollup_states.items()))


def term_totals(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """``term, n_rows, n_records, n_row_groups, entry_rows, unlisted_rows``: totals of every term over all row groups.

    ``postings``: row_group, term, postings (lists may overlap, repeat, be empty or null); ``entries``: row_group, term,
    postings_count (may repeat).  A posting list can be reached by its dictionary entry, so the two meet by row group and
    term: each is reduced to one state there, the states are joined, and the joined states are rolled up by term.
    All states are numbers that are combined before every shuffle (row ids are sets of up to 64 as one number), so neither
    a term of a third of all rows nor a record written over and over gathers in a task.

    ``n_rows``: distinct row ids of lists that have an entry; ``unlisted_rows``: of lists that have none, which no lookup
    would find.  ``n_records``: posting records as they stand.  ``n_row_groups``, ``entry_rows``: row groups whose dictionary has
    the term, and its rows there as told (0 and null if it is in none).
    Null terms, null and empty lists and null row ids count nowhere; terms without any row id give no row.
    """
    lists = postings.where(F.col("term").isNotNull() & (F.size("postings") > 0)).select("row_group", "term", F.posexplode("postings").alias("at", "id"))
    bit = F.expr("shiftleft(1L, CAST(pmod(id, 64) AS INT))")
    sets = lists.groupBy("row_group", "term", F.expr("id div 64 - CAST(id < 0 AND id % 64 <> 0 AS INT)").alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.count_if(F.col("at") == 0).alias("records"))
    listed, ids = F.col("told").isNotNull(), F.coalesce("ids", F.lit(0))
    totals = eager_join_aggregate(
        sets, entries.where(F.col("postings_count") > 0), ["row_group", "term"],
        left_states={"ids": F.sum(F.bit_count("bits")), "records": F.sum("records")},
        right_states={"told": F.max("postings_count")},
        combine={"ids": F.when(listed, ids).otherwise(0), "unlisted": F.when(listed, 0).otherwise(ids), "records": F.col("records"), "told": F.col("told")},
        rollup=["term"],
        rollup_states={
            "n_rows": F.sum("ids").cast("bigint"),
            "n_records": F.sum("records").cast("bigint"),
            "n_row_groups": F.count("told").cast("bigint"),
            "entry_rows": F.sum("told").cast("bigint"),
            "unlisted_rows": F.sum("unlisted").cast("bigint"),
        },
        how="left",
    )
    return totals.where(F.col("n_rows") + F.col("unlisted_rows") > 0)


def dominant_terms(totals: DataFrame, share: int = 80) -> DataFrame:
    """The terms of ``totals`` that hold at least 1/``share`` of all (term, row id) pairs of listed rows: ``term, n_rows``."""
    total = totals.agg(F.sum("n_rows").alias("n")).first()["n"] or 0
    return totals.where(F.col("n_rows") * F.lit(share) >= F.lit(total)).where("n_rows > 0").select("term", "n_rows")


def join_sums(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """``term, joined_rows, sum_count``: COUNT(*) and SUM(postings_count) of postings JOIN entries ON term, by term.

    The join's rows, the product of both sides per term, are never made.  Null terms match nothing.
    """
    return eager_join_aggregate(
        postings.select("term"), entries.select("term", "postings_count"), ["term"],
        left_states={"n_left": F.count("*")},
        right_states={"n_right": F.count("*"), "s_right": F.sum("postings_count")},
        combine={"joined": F.col("n_left") * F.col("n_right"), "summed": F.col("n_left") * F.col("s_right")},
        rollup=["term"],
        rollup_states={"joined_rows": F.sum("joined").cast("bigint"), "sum_count": F.sum("summed").cast("bigint")},
    )
