import random
from collections import defaultdict

import pytest

from tokensift.operators.eager import dominant_terms, eager_join_aggregate, join_sums, term_totals
from pyspark.sql import functions as F

POSTINGS, ENTRIES = "row_group long, term string, postings array<long>, extra int, n_rows int", "row_group long, term string, postings_count long, extra int"


def tables(spark, seed=1, rows=300):
    r = random.Random(seed)
    postings, entries = [], []
    for _ in range(rows):
        g, t = r.randrange(5), r.choice(["hot"] * 6 + list("abcdef") + [None, ""])
        postings.append((g, t, r.choice([None, [], [g * 256 + r.randrange(30) for _ in range(r.randrange(5))] + [None] * r.randrange(2)]), 1, 7))
    pairs = defaultdict(set)
    for g, t, ids, *_ in postings:
        if t is not None:
            pairs[g, t] |= {i for i in ids or [] if i is not None}
    for (g, t), ids in pairs.items():
        if ids:
            entries += [(g, t, len(ids), 1)] * r.choice([1, 1, 2])
    entries.append((0, None, 5, 1))
    return spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(entries, ENTRIES), postings, entries, pairs


def test_term_totals(spark):
    p, e, postings, entries, pairs = tables(spark)
    want = {}
    for (g, t), ids in pairs.items():
        if ids:
            old = want.setdefault(t, [0, 0, 0, 0])
            old[0] += len(ids)
            old[1] += 1
            old[3] += len(ids)
    for g, t, ids, *_ in postings:
        if t in want and ids:
            want[t][2] += 1
    got = {r.term: [r.n_rows, r.n_row_groups, r.n_records, r.entry_rows] for r in term_totals(p, e).collect()}
    assert got == want
    total = sum(w[0] for w in want.values())
    assert {r.term for r in dominant_terms(term_totals(p, e), 5).collect()} == {t for t, w in want.items() if w[0] * 5 >= total}


def test_the_join_decides(spark):
    """Lists without an entry are told apart: no dictionary, no listed rows."""
    p, e, _, _, pairs = tables(spark)
    alone = term_totals(p, e.limit(0))
    assert {r.term: (r.n_rows, r.unlisted_rows, r.n_row_groups, r.entry_rows) for r in alone.collect()} == {t: (0, sum(len(i) for (_, u), i in pairs.items() if u == t), 0, None) for t in {t for (_, t), i in pairs.items() if i}}
    assert dominant_terms(alone).count() == 0 and term_totals(p.limit(0), e).count() == 0
    without = term_totals(p, e.where("row_group <> 3"))
    assert {r.term: r.unlisted_rows for r in without.collect()} == {t: len(pairs.get((3, t), ())) for t in {t for (_, t), i in pairs.items() if i}}


def test_a_record_written_over_and_over(spark):
    p = spark.range(20_000).selectExpr("-1L AS row_group", "'hot' AS term", "array(-1L, -64L, -65L, -128L, NULL, -1L) AS postings", "0 AS extra", "0 AS n_rows")
    got = term_totals(p, spark.createDataFrame([(-1, "hot", 4, 0)], ENTRIES)).collect()
    assert [tuple(r) for r in got] == [("hot", 4, 20_000, 1, 4, 0)]


def test_join_sums(spark):
    p, e, postings, entries, _ = tables(spark, 2)
    want = defaultdict(lambda: [0, 0])
    for _, t, *_ in postings:
        for _, u, n, _ in entries:
            if t is not None and t == u:
                want[t][0] += 1
                want[t][1] += n
    assert {r.term: [r.joined_rows, r.sum_count] for r in join_sums(p, e).collect()} == dict(want)


def test_empty(spark):
    p, e = spark.createDataFrame([], POSTINGS), spark.createDataFrame([], ENTRIES)
    assert term_totals(p, e).count() == join_sums(p, e).count() == dominant_terms(term_totals(p, e)).count() == 0


def test_clashing_states(spark):
    p, e = spark.createDataFrame([], POSTINGS), spark.createDataFrame([], ENTRIES)
    with pytest.raises(ValueError):
        eager_join_aggregate(p, e, ["term"], {"n": F.count("*")}, {"n": F.count("*")}, {}, ["term"], {})
