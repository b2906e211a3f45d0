import random
from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokensift.llm.burst_trie import BurstTrie, indexed_rows, mark_terms, route_bounds, routes_of, term_frequencies, trie_containers, trie_counts

POSTINGS, ENTRIES = "row_group long, term string, postings array<long>, mark string", "row_group long, term string, postings_count long, mark string"


def node_table(adds):
    return pa.table({"term": pa.array([x[0] for x in adds], pa.string()), "occurrences": pa.array([x[1] for x in adds], pa.int64()), "n_rows": pa.array([x[2] for x in adds], pa.int64())})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abé😀\U0010ffff", max_size=6), st.integers(0, 5), st.integers(0, 3)), max_size=80), st.integers(1, 5))
def test_trie_counts_like_a_table(adds, burst):
    trie, want = BurstTrie(burst, 7), defaultdict(lambda: [0, 0])
    for i in range(0, len(adds), 9):
        trie.add(node_table(adds[i : i + 9]))
    for t, a, b in adds:
        want[t][0] += a
        want[t][1] += b
    table = trie.sorted()
    terms = table["term"].to_pylist()
    assert dict(zip(terms, map(list, zip(table["occurrences"].to_pylist(), table["n_rows"].to_pylist())))) == dict(want)
    nodes = list(trie.containers(terms))
    assert [i for low, high, _ in nodes for i in range(low, high)] == list(range(len(terms)))
    assert all(high - low <= burst and len({t[:shared] for t in terms[low:high]}) == 1 for low, high, shared in nodes)


def test_routes():
    bounds = ["", "t", "tra"]
    assert [routes_of(bounds, x, x)[0] for x in ("", "a", "t", "tr", "tra", "trace", "u")] == [0, 0, 1, 1, 2, 2, 2]


def test_a_shared_prefix_spreads(spark):
    """A hundred thousand terms that begin with the same 60 characters go over many routes, evenly."""
    df = spark.range(100_000).select(F.format_string("x" * 60 + "%07d", F.col("id") * 7919 % 1_000_003).alias("term"), F.lit(1).alias("occurrences"), F.lit(1).alias("n_rows")).repartition(6)
    bounds = route_bounds(trie_containers(df), 2000)
    assert len(bounds) >= 30 and bounds == sorted(set(bounds))
    sizes = Counter(routes_of(bounds, r.term, r.term)[0] for r in df.select("term").collect())
    assert max(sizes.values()) < 15_000
    counts = trie_counts(df, 2000)
    assert counts.count() == 100_000 and counts.where("occurrences <> 1 OR n_rows <> 1").count() == 0


def terms(seed, n=3000):
    r = random.Random(seed)
    return [r.choice(["hot", "trace=%08x" % r.randrange(800), "w%d" % int(r.paretovariate(0.8)), "", None, "é😀", "x" * 3000]) for _ in range(n)]


def test_counts_by_routes(spark):
    values = terms(1)
    df = spark.createDataFrame([(t, i % 3, None if i % 11 == 0 else 1) for i, t in enumerate(values)], "term string, occurrences int, n_rows int").repartition(5)
    want = defaultdict(lambda: [0, 0])
    for i, t in enumerate(values):
        if t is not None:
            want[t][0] += i % 3
            want[t][1] += i % 11 != 0
    for entries, burst in ((10, 3), (100, 50), (1 << 18, 512)):
        rows = trie_counts(df, entries, burst).collect()
        assert len(rows) == len(want) and {r.term: [r.occurrences, r.n_rows] for r in rows} == dict(want)


def test_a_task_of_many_entries(spark):
    """One task sums its entries up while further batches, whose counters cannot be null, still come."""
    df = spark.range(0, 1_200_000, 1, 1).select(F.format_string("t%04d", F.col("id") % 3000).alias("term"), F.lit(2).alias("occurrences"), F.lit(1).alias("n_rows"))
    assert {r.term: (r.occurrences, r.n_rows) for r in trie_counts(df).collect()} == {"t%04d" % i: (800, 400) for i in range(3000)}


def test_frequencies_and_marks(spark):
    r = random.Random(4)
    pairs = defaultdict(set)
    for row in range(400):
        for t in ["everywhere"] * (row % 5 != 0) + ["t%d" % r.randrange(60), "once%d" % row if row % 7 == 0 else "few"]:
            pairs[row // 16, t].add(row)
    postings = [(g, t, sorted(ids) + sorted(ids)[:1], "x") for (g, t), ids in pairs.items()] + [(0, None, [5], "x"), (0, "null list", None, "x"), (1, "few", [], "x")]
    entries = [(g, t, len(ids), "x") for (g, t), ids in pairs.items()] * 2
    p, e = spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(entries, ENTRIES)
    got = {x.term: (x.occurrences, x.n_rows) for x in term_frequencies(p, e).collect()}
    rows = defaultdict(set)
    for (g, t), ids in pairs.items():
        rows[t] |= ids
    groups = defaultdict(int)
    for g, t in pairs:
        groups[t] += 1
    assert got == {t: (len(ids) + groups[t], len(ids)) for t, ids in rows.items()} | {"null list": (0, 0)}
    n = indexed_rows(p)
    assert n == len(set().union(*rows.values()))
    marks = {x.term: x.mark for x in mark_terms(term_frequencies(p, e), n).collect()}
    assert marks == {t: "rare" if len(ids) == 1 else "common" if len(ids) * 10 >= n else None for t, ids in rows.items()} | {"null list": None}


def test_empty(spark):
    p, e = spark.createDataFrame([], POSTINGS), spark.createDataFrame([], ENTRIES)
    assert term_frequencies(p, e).count() == indexed_rows(p) == 0
