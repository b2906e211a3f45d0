import random
from collections import defaultdict
from fractions import Fraction
from math import comb, log

import numpy as np
import pytest

from tokensift.llm.enrichment import characteristic_terms, distinctive_terms, log_factorial, log_upper_tail

POSTINGS, ENTRIES = "row_group long, term string, postings array<long>, n int", "row_group long, term string, postings_count long, k int"


def tail(k, K, n, N):
    return log(Fraction(sum(comb(K, i) * comb(N - K, n - i) for i in range(k, min(K, n) + 1)), comb(N, n)))


def test_log_factorial():
    x = np.array([0, 1, 2, 10, 4094, 4095, 4096, 5000, 10**6])
    from math import lgamma

    assert np.allclose(log_factorial(x), [lgamma(float(v) + 1) for v in x], rtol=1e-13, atol=1e-12)


def test_tails_against_exact_fractions():
    r = random.Random(3)
    cases = []
    for _ in range(300):
        N = r.randrange(1, 400)
        n, K = r.randrange(0, N + 1), r.randrange(0, N + 1)
        low, high = max(0, n + K - N), min(n, K)
        cases.append((r.randrange(low, high + 1), K, n, N))
    got = log_upper_tail(*np.array(cases).T)
    assert np.allclose(got, [tail(*c) for c in cases], rtol=1e-9, atol=1e-9)
    assert len(log_upper_tail(*np.zeros((4, 0)))) == 0


def data(spark, seed=1):
    r = random.Random(seed)
    pairs = defaultdict(set)
    for row in range(600):
        g = row // 20
        for t in ["common"] * (r.random() < 0.8) + ["t%d" % r.randrange(40)] + (["mark%d" % g] if r.random() < 0.75 else []):
            pairs[g, t].add(row)
    postings = [(g, t, sorted(ids), 1) for (g, t), ids in pairs.items()] + [(0, None, [1], 1), (0, "none", None, 1), (0, "none", [], 1), (3, "common", sorted(pairs[3, "common"]), 1)]
    entries = [(g, t, len(ids), 1) for (g, t), ids in pairs.items()] * 2 + [(1, None, 4, 1)]
    return spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(entries, ENTRIES), pairs


def test_scores(spark):
    p, e, pairs = data(spark)
    rows = {(r.row_group, r.term): r for r in distinctive_terms(p, e).collect()}
    assert set(rows) == set(pairs)
    K, n = defaultdict(int), defaultdict(set)
    for (g, t), ids in pairs.items():
        K[t] += len(ids)
        n[g] |= ids
    N = sum(map(len, n.values()))
    want = {(g, t): tail(len(ids), K[t], len(n[g]), N) for (g, t), ids in pairs.items()}
    order = sorted(want, key=want.get)
    ranks = {key: sum(want[o] <= want[key] + 1e-12 for o in order) for key in order}
    q, low = {}, 0.0
    for key in reversed(order):
        low = min(low, want[key] + log(len(order) / ranks[key]))
        q[key] = low
    for key, r in rows.items():
        assert (r.k, r.total, r.n, r.collection) == (len(pairs[key]), K[key[1]], len(n[key[0]]), N)
        assert r.log_p == pytest.approx(want[key], abs=1e-8)
        assert r.score == pytest.approx(-q[key], abs=1e-8)


def test_characteristic(spark):
    p, e, pairs = data(spark, 2)
    found = {(r.row_group, r.term) for r in characteristic_terms(distinctive_terms(p, e)).collect()}
    total = defaultdict(int)
    for (g, t), ids in pairs.items():
        total[t] += len(ids)
    assert found == {(g, t) for (g, t), ids in pairs.items() if len(ids) >= 12 and len(ids) * 100 >= total[t] * 80} and found


def test_edges(spark):
    assert distinctive_terms(spark.createDataFrame([], POSTINGS), spark.createDataFrame([], ENTRIES)).count() == 0
    one = distinctive_terms(spark.createDataFrame([(0, "a", list(range(15)), 1)], POSTINGS), spark.createDataFrame([(0, "a", 15, 1)], ENTRIES))
    assert one.first().score == 0.0
    assert characteristic_terms(one).count() == 0  # one row group holds all rows: nothing tells it from the collection


def test_the_score_decides(spark):
    """A term can hold the rule by chance in a row group of nine tenths of all rows; it does not stand out there."""
    ids = list(range(1000))
    spread_, own = ids[100:114] + [950], ids[900:915]
    pairs = {(0, "all"): ids[:900], (1, "all"): ids[900:], (0, "spread"): spread_[:14], (1, "spread"): spread_[14:], (1, "own"): own}
    p = spark.createDataFrame([(g, t, i, 1) for (g, t), i in pairs.items()], POSTINGS)
    e = spark.createDataFrame([(g, t, len(i), 1) for (g, t), i in pairs.items()], ENTRIES)
    scored = distinctive_terms(p, e)
    assert {(r.row_group, r.term) for r in characteristic_terms(scored).collect()} == {(1, "own")}
    assert (0, "spread") in {(r.row_group, r.term) for r in characteristic_terms(scored, fdr=1.0).collect()}
    assert characteristic_terms(scored, fdr=1e-100).count() == 0


def test_long_tails_stop_early():
    """Row groups of the largest size: sums of many terms, against whole sums."""
    from math import lgamma

    cases = [(40_000, 100_000, 122_880, 300_000), (41_200, 100_000, 122_880, 300_000), (600, 1500, 122_880, 10**9), (2, 100_000, 122_880, 10**10), (49_000, 120_000, 122_880, 300_000)]
    for case, got in zip(cases, log_upper_tail(*np.array(cases).T)):
        k, K, n, N = case

        def c(a, b):
            return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)

        lp = np.array([c(K, i) + c(N - K, n - i) - c(N, n) for i in range(k, min(K, n) + 1)])
        assert got == pytest.approx(min(0.0, lp.max() + np.log(np.exp(lp - lp.max()).sum())), abs=2e-3, rel=1e-6)
