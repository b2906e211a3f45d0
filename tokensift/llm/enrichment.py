"""How distinctive a term is of its row group: hypergeometric enrichment with false-discovery adjustment.

Of N rows of the collection, n lie in the row group; a term has K rows in all and k in the row group.  If the term were
spread by chance, k would follow the hypergeometric distribution; the score is the negative natural logarithm of the
exact upper tail P(X >= k), adjusted by Benjamini and Hochberg over all (row group, term) pairs.  Pairs with equal
(k, K, n) have equal tails, so the tail is computed once for each combination, of which there are far fewer than pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokensift.llm.shipping import ship
from tokensift.llm.splitting import split_join
from tokensift.sources.tables import materialized

_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


@lru_cache(1)
def _small() -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, 4096.0)))])


def log_factorial(x: np.ndarray) -> np.ndarray:
    """ln(x!) for whole x >= 0: sums of logarithms below 4096, the Stirling series of ln(gamma(x + 1)) above."""
    x = np.asarray(x, dtype=np.float64)
    table = _small()
    z = np.maximum(x, 1.0) + 1.0
    inverse, series = 1.0 / z, 0.0
    for i, c in enumerate(_STIRLING):
        series = series + c * inverse ** (2 * i + 1)
    large = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series
    return np.where(x < len(table), table[np.minimum(x, len(table) - 1).astype(np.int64)], large)


def log_upper_tail(k: np.ndarray, K: np.ndarray, n: np.ndarray, N: np.ndarray, block: int = 1 << 20, step: int = 512) -> np.ndarray:
    """ln P(X >= k) for X hypergeometric(N, K, n); 0 where k is no more than the least possible value.

    The terms are summed ``step`` at a time, from k on.  Past the mode they fall faster and faster, so a row is done once its
    last term is below e**-40 of its sum, however many terms there are.
    """
    k, K, n, N = (np.asarray(a, dtype=np.float64) for a in (k, K, n, N))
    out = np.full(len(k), -np.inf)
    terms = np.minimum(K, n) - k + 1
    whole = k <= np.maximum(0, n + K - N)
    order = np.argsort(np.minimum(terms, step), kind="stable")
    order = order[~whole[order]]
    at = 0
    while at < len(order):
        # rows with a similar number of terms, as one matrix of bounded size
        width = max(1, int(min(terms[order[at]], step)))
        end = at + int(np.searchsorted(np.minimum(terms[order[at : at + max(1, block // width)]], step), max(width * 1.25, 8), "right"))
        rows = order[at : max(end, at + 1)]
        at += len(rows)
        width, done = max(1, int(min(terms[rows].max(), step))), 0
        while len(rows):
            kk, KK, nn, NN = (a[rows][:, None] for a in (k, K, n, N))
            i = kk + done + np.arange(width)[None, :]
            fits = i <= np.minimum(KK, nn)
            i = np.where(fits, i, kk)
            fits &= nn - i <= NN - KK
            log_p = (
                log_factorial(KK) - log_factorial(i) - log_factorial(KK - i)
                + log_factorial(NN - KK) - log_factorial(nn - i) - log_factorial(np.maximum(NN - KK - nn + i, 0))
                - log_factorial(NN) + log_factorial(nn) + log_factorial(NN - nn)
            )
            log_p = np.where(fits, log_p, -np.inf)
            top = np.maximum(log_p.max(axis=1), out[rows])
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                out[rows] = safe + np.log(np.exp(log_p - safe[:, None]).sum(axis=1) + np.exp(out[rows] - safe))
            done += width
            falling = (log_p[:, -1] < log_p[:, 0]) & (log_p[:, -1] < out[rows] - 40)
            rows = rows[(terms[rows] > done) & ~falling]
    return np.where(whole, 0.0, np.minimum(out, 0.0))


def pair_counts(postings: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The pairs ``row_group, term, k``; the row groups' sizes ``row_group, n``; and N.

    A row counts if it has any term.  Null terms, lists and row ids count nowhere; an entry counts once.
    """
    pairs = entries.where(F.col("term").isNotNull() & (F.col("postings_count") > 0)).groupBy("row_group", "term").agg(F.max("postings_count").cast("bigint").alias("k"))
    ids = postings.where(F.col("term").isNotNull()).select("row_group", F.explode("postings").alias("id")).where("id IS NOT NULL AND row_group IS NOT NULL")
    # ids in sets of 64 as one number, which the tasks combine before the shuffle
    sets = ids.groupBy("row_group", F.expr("id div 64 - CAST(id < 0 AND id % 64 <> 0 AS INT)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(id, 64) AS INT))")).alias("bits"))
    sizes = materialized(sets.groupBy("row_group").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n")), "group-sizes")
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    return pairs, sizes, total


def adjusted(combinations: DataFrame, tests: int) -> DataFrame:
    """``combinations`` (.., log_p, pairs) with ``log_q``, Benjamini-Hochberg over ``tests`` pairs.

    q = min over p' >= p of p' * tests / rank(p').  The combinations are sorted over all tasks; every range reports one
    row (pairs in it, least raw value), from which the driver gives each range the pairs before it and the least value
    after it.  Within a range, which is bounded, windows do the rest.
    """
    spark = combinations.sparkSession
    ranges = materialized(combinations.orderBy("log_p").withColumn("range", F.spark_partition_id()), "p-ranges")
    counts = {r["range"]: r["pairs"] for r in ranges.groupBy("range").agg(F.sum("pairs").alias("pairs")).collect()}
    before, seen = [], 0
    for r in sorted(counts):
        before.append((r, seen))
        seen += counts[r]
    up = Window.partitionBy("range").orderBy("log_p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = spark.createDataFrame(before, "range int, before bigint")
    raw = ranges.join(F.broadcast(offsets), "range").withColumn("rank", F.sum("pairs").over(up) + F.col("before"))
    raw = raw.withColumn("raw", F.col("log_p") + F.log(F.lit(float(max(tests, 1))) / F.col("rank")))
    least = {r["range"]: r["raw"] for r in raw.groupBy("range").agg(F.min("raw").alias("raw")).collect()}
    after, low = [], 0.0
    for r in sorted(least, reverse=True):
        after.append((r, low))
        low = min(low, least[r])
    down = Window.partitionBy("range").orderBy(F.desc("log_p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = spark.createDataFrame(after, "range int, after double")
    return raw.join(F.broadcast(bounds), "range").withColumn("log_q", F.least(F.min("raw").over(down), F.col("after"), F.lit(0.0))).drop("range", "before", "rank", "raw", "after")


def distinctive_terms(postings: DataFrame, entries: DataFrame) -> DataFrame:
    """``row_group, term, k, total, n, collection, log_p, score`` of every pair of row group and term; ``score`` is -ln q, >= 0.

    k of the term's ``total`` rows lie in the row group, which has n of the ``collection``'s rows.  An empty collection gives no row; a row group
    that no posting list knows gives none either; a collection of one row group gives score 0 throughout.
    """
    ship(postings.sparkSession)
    pairs, sizes, N = pair_counts(postings, entries)
    totals = pairs.groupBy("term").agg(F.sum("k").alias("total"))
    full = materialized(pairs.join(totals, "term").join(sizes, "row_group"), "pairs")
    combinations = full.groupBy("k", "total", "n").agg(F.count("*").alias("pairs"))
    tests = full.count()

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(log_p=log_upper_tail(batch["k"], batch["total"], batch["n"], np.full(len(batch), N)))

    # a fixed number of partitions: few bytes, but much to compute
    tasks = int(combinations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = combinations.repartition(tasks).mapInPandas(tails, "k bigint, total bigint, n bigint, pairs bigint, log_p double")
    levels = adjusted(materialized(scored, "tails"), tests).select("k", "total", "n", "pairs", "log_p", (-F.col("log_q")).alias("score"))
    # rare terms share few combinations: those of more than a thousandth of all pairs are split
    return split_join(full, materialized(levels, "levels"), ["k", "total", "n"], "pairs").select("row_group", "term", "k", "total", "n", F.lit(N).cast("bigint").alias("collection"), "log_p", "score")


def characteristic_terms(scored: DataFrame, min_rows: int = 12, percent: int = 80, fdr: float = 0.05) -> DataFrame:
    """The pairs that stand out by their score at the false-discovery rate ``fdr``, and of these the ones with at least
    ``min_rows`` rows that are ``percent`` of the term's rows.

    The score rules first: in a row group of most of the collection a term can have nearly all its rows by chance, and is
    not characteristic.  In a row group of no more than a twentieth of all rows, a pair with 12 rows and 80 % has a tail below
    C(15, 12) / 20^12 and stands out among any number of pairs below 10^11.
    """
    standing_out = scored.where(F.col("score") >= F.lit(-float(np.log(fdr))))
    return standing_out.where((F.col("k") >= min_rows) & (F.col("k") * 100 >= F.col("total") * percent))
