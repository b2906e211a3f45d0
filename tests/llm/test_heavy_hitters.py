import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tokensift.llm import heavy_hitters
from tokensift.llm.heavy_hitters import MisraGries, bounds, frequent_values, summarize, top_values


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=6), st.integers(1, 8))
def test_merged_bounds(parts, counters):
    whole, merged = Counter(), MisraGries(counters)
    for part in parts:
        own = MisraGries(counters)
        for i in range(0, len(part), 7):
            c = Counter(map(str, part[i : i + 7]))
            own.add(list(c), list(c.values()))
        whole.update(map(str, part))
        merged.merge(list(own.counts), list(own.counts.values()), own.error, own.total)
    assert merged.total == sum(whole.values()) and len(merged.counts) <= counters
    assert merged.error * (counters + 1) <= merged.total
    for v, n in whole.items():
        assert merged.counts.get(v, 0) <= n <= merged.counts.get(v, 0) + merged.error


def skewed(seed, n=5000):
    r = random.Random(seed)
    return [r.choice(["hot"] * 5 + ["w%d" % int(r.paretovariate(0.7)), None, ""]) for _ in range(n)]


def test_frequent_and_top(spark):
    values = skewed(1)
    df = spark.createDataFrame([(v, i, 0) for i, v in enumerate(values)], "term string, value int, n int").repartition(7)
    true = Counter(v for v in values if v is not None)
    held = {r.value: (r.at_least, r.at_most) for r in bounds(df, "term", 20).collect()}
    assert all(a <= true[v] <= b for v, (a, b) in held.items())
    assert {v for v, n in true.items() if n > sum(true.values()) / 21} <= set(held)
    for share in (5, 20, 300):
        assert {tuple(r) for r in frequent_values(df, "term", share).collect()} == {(v, n) for v, n in true.items() if n * share > sum(true.values())}
    for counters in (2, 5, 1000):
        got = [(r.value, r.n) for r in top_values(df, "term", 10, counters).collect()]
        assert got == sorted(true.items(), key=lambda x: (-x[1], x[0]))[:10]


def test_flat_column_stays_bounded(spark, monkeypatch):
    """No value stands out: the summary cannot tell, and its size does not grow without bound."""
    df = spark.range(20_000).select(F.concat(F.lit("v"), F.col("id") % 5000).alias("term")).repartition(5)
    sizes, real = [], heavy_hitters._bounded
    monkeypatch.setattr(heavy_hitters, "_bounded", lambda df, column, counters: sizes.append(counters) or real(df, column, counters))
    assert [tuple(r) for r in top_values(df, "term", 2, 64, 1000).collect()] == [("v0", 4), ("v1", 4)]
    assert sizes == [64, 1000]
    assert [r.value for r in top_values(df, "term", 2, 64, 100_000).collect()] == ["v0", "v1"]
    assert sizes == [64, 1000, 64, 100_000]


def test_levels(spark):
    """400 tasks merge in three levels with a shuffle before each, and none but the last has one task."""
    df = spark.createDataFrame([(v,) for v in skewed(2)], "term string").repartition(400)
    summary = summarize(df, "term", 8)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan
    assert re.findall(r"Exchange shufflepartitionidpassthrough\(.*?, (\d+)\)", plan) == ["2", "25"] and plan.count("SinglePartition") == 1
    total = sum(v is not None for v in skewed(2))
    assert [r.total for r in summary.collect() if r.value is None] == [total]


def test_ties_and_edges(spark):
    df = spark.createDataFrame([(c,) for c in "dcbaabcd"], "term string")
    assert [r.value for r in top_values(df, "term", 3, 2).collect()] == ["a", "b", "c"]
    none = spark.createDataFrame([(None,)], "term string")
    assert top_values(none, "term", 3).count() == frequent_values(none.limit(0), "term").count() == bounds(none, "term").count() == 0
    assert [tuple(r) for r in summarize(none, "term").collect()] == [(None, 0, 0, 0)]
    with pytest.raises(ValueError):
        MisraGries(0)
