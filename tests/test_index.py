import pytest
from pyspark.sql import functions as F

from tokensift import BindError, UnsupportedError
from tokensift.operators.catalog import TokenEngine
from tokensift.operators.index import InvertedIndex, build_index
from tokensift.operators.search import AllTokens, AnyTokens, Token, Where, _ranges, search
from tokensift.sources.tables import laid_out

ROWS = [(0, "a b a"), (1, None), (2, "B c"), (3, ""), (5, "ab " + "x" * 500), (7, "b  b\tB"), (8, "c"), (40, "a z")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, message string").withColumn("n", F.length("message")).cache()


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return InvertedIndex.write(build_index(table, "id", "message", 4), str(tmp_path_factory.mktemp("index")), 4)


def brute():
    out = {}
    for i, t in ROWS:
        for w in set((t or "").lower().split()):
            out.setdefault((i // 4, w), []).append(i)
    return out


def test_postings(index):
    assert {(r.row_group, r.term): r.row_ids for r in index.table.collect()} == brute()
    assert all(r.postings_count == len(r.row_ids) for r in index.table.collect())
    assert index.violations().count() == 0
    assert index.num_partitions() == 4 and index.total_dictionary_size() == len(brute())
    stats = {r.row_group: (r.num_terms, r.min_row_id, r.max_row_id) for r in index.partition_stats().collect()}
    assert stats == {0: (3, 0, 2), 1: (3, 5, 7), 2: (1, 8, 8), 10: (2, 40, 40)}


@pytest.mark.parametrize("term,ids", [("a", [0, 40]), ("b", [0, 2, 7]), ("", []), ("A", []), ("ab", [5]), ("x" * 500, [5]), ("none", [])])
def test_lookup(index, term, ids):
    assert [r.row_id for r in index.lookup(term).collect()] == ids


TREES = [
    Token("a"), Token("B "), Token(""), Token("none"), ~Token("a"), ~Token(" "), AllTokens(["a", "b"]), AllTokens([]), AllTokens([""]), AnyTokens([]), AnyTokens(["a", "c"]), AnyTokens(["", "q"]),
    ~AllTokens(["a", "b"]), Token("b") & ~Token("a"), ~Token("b") & ~Token("a"), ~Token("b") | Token("a"), ~Token("b") | ~Token("c"), (Token("a") | Token("c")) & ~(Token("z") | Token("none")),
    ~(~Token("a") & ~(Token("c") | Token("b"))), AnyTokens(["none"]) | ~Token("none"), Token(None), AllTokens(None), ~Token(None) | Token("a"),
]


@pytest.mark.parametrize("tree", TREES, ids=range(len(TREES)))
def test_index_and_scan_agree(table, index, tree):
    by_scan = [r.id for r in search(table, "id", "message", tree).orderBy("id").collect()]
    for path in ("auto", "join"):
        assert [r.id for r in search(table, "id", "message", tree, index, path=path).orderBy("id").collect()] == by_scan


def test_filters_with_the_index(table, index):
    both = Token("b") & Where(F.col("n") > 3)
    either = Token("a") | Where(F.col("n") == 1)
    assert [r.id for r in search(table, "id", "message", both, index).orderBy("id").collect()] == [0, 7]
    assert [r.id for r in search(table, "id", "message", either, index).orderBy("id").collect()] == [0, 8, 40]


def test_rows_that_repeat_and_odd_tables(spark):
    twice = spark.createDataFrame([(3, "a"), (3, "a"), (4, "a b")], "id int, message string").withColumn("term", F.lit("clash")).withColumn("row_id", F.lit(9))
    assert {(r.row_group, r.term): r.row_ids for r in build_index(twice, "id", "message", 2).collect()} == {(1, "a"): [3], (2, "a"): [4], (2, "b"): [4]}
    empty = spark.createDataFrame([], "id int, message string")
    built = InvertedIndex(build_index(empty, "id", "message"))
    assert built.table.count() == built.num_partitions() == built.total_dictionary_size() == 0
    assert search(empty, "id", "message", ~Token("a"), built).count() == 0
    with pytest.raises(Exception, match="row ids"):
        build_index(spark.createDataFrame([(-1, "a")], "id int, message string"), "id", "message").collect()
    with pytest.raises(Exception, match="ASCII"):
        build_index(spark.createDataFrame([(1, "é")], "id int, message string"), "id", "message").collect()


def test_violations(spark):
    bad = spark.createDataFrame([(0, "", [1], 1), (0, "a", [2, 1], 2), (0, "b", [1, 9], 2), (0, "c", [1], 5), (0, "d", [], 0), (0, "e", [0], 1), (0, "e", [1], 1)], "row_group long, term string, row_ids array<long>, postings_count long")
    assert sorted((r.term, r.problem) for r in InvertedIndex(bad, 4).violations().collect()) == [
        ("", "empty term"), ("a", "row ids do not ascend"), ("b", "row id outside its row group"), ("c", "count differs from list"), ("d", "no row ids"), ("e", "term occurs twice")]


def test_catalogue(spark, table):
    engine = TokenEngine(spark)
    engine.register("logs", table, "id")
    engine.create_index("i", "logs", "message", row_group_size=4)
    engine.create_index("i", "logs", "message", if_not_exists=True)
    assert [tuple(r) for r in engine.indexes().collect()] == [("i", "logs", "message", False)]
    assert engine.search("logs", "message", ~Token("b")).count() == 4
    for error, call in (
        (BindError, lambda: engine.create_index("i", "logs", "message")), (BindError, lambda: engine.create_index("j", "logs", "message", unique=True)),
        (BindError, lambda: engine.create_index("j", "logs", "n")), (BindError, lambda: engine.create_index("j", "logs", "message", fast=True)),
        (BindError, lambda: engine.create_index("j", "nowhere", "message")), (BindError, lambda: engine.create_index("j", "logs", "message", row_group_size=0)),
        (ValueError, lambda: engine.create_index("j", "logs", "message", row_group_size=1 << 64)), (UnsupportedError, lambda: engine.create_index("j", "logs", ["message", "n"])),
        (UnsupportedError, lambda: engine.create_index("j", "logs", F.lower("message"))), (UnsupportedError, lambda: engine.create_index("j", "logs", "lower(message)")),
        (UnsupportedError, lambda: engine.append("i", table)), (BindError, lambda: engine.drop_index("j")), (BindError, lambda: engine.index("j")),
    ):
        with pytest.raises(error):
            call()
    engine.drop_index("j", if_exists=True)
    engine.drop_index("i")
    assert engine.indexes().count() == 0


def test_lookup_pushes_the_term_down(index):
    plan = index.table.where(F.col("term") == "b").select("row_ids")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,b)" in plan and "postings_count" not in plan.split("ReadSchema")[1]


def test_an_index_never_changes_an_answer(spark):
    engine = TokenEngine(spark)
    engine.register("mixed", spark.createDataFrame([(0, "error a"), (1, "\u00e9 error"), (2, "fine"), (3, None)], "id long, message string"), "id")
    engine.create_index("m", "mixed", "message", non_ascii="null")
    for path in ("auto", "join"):
        for tree in (Token("error"), ~Token("error"), Token("error") & ~Token("a")):
            with pytest.raises(Exception, match="ASCII"):
                engine.search("mixed", "message", tree, path=path).collect()
            scan = engine.search("mixed", "message", tree, "null", "scan").orderBy("id").collect()
            assert engine.search("mixed", "message", tree, "null", path).orderBy("id").collect() == scan


def test_a_table_registered_again_loses_its_indexes(spark):
    engine = TokenEngine(spark)
    engine.register("logs", spark.createDataFrame([(0, "error"), (1, "x")], "id long, message string"), "id")
    engine.create_index("e", "logs", "message")
    engine.register("logs", spark.createDataFrame([(0, "x"), (1, "error")], "id long, message string"), "id")
    assert engine.indexes().count() == 0
    for path in ("auto", "join"):
        assert [tuple(r) for r in engine.search("logs", "message", Token("error"), path=path).collect()] == [(1, "error")]


def test_generated_column(spark):
    engine = TokenEngine(spark)
    engine.register("logs", spark.createDataFrame([(0, "error a"), (1, "fine")], "id long, message string").withColumn("upper_message", F.upper("message")), "id")
    engine.create_index("u", "logs", "upper_message")
    assert [r.id for r in engine.search("logs", "upper_message", Token("ERROR")).collect()] == [0]
    assert [r.row_id for r in engine.index("u").lookup("error").collect()] == [0]


def test_scan_is_narrowed(spark, tmp_path):
    """Rare tokens push ranges of ids into the scan of a table laid out by id; common ones and NOT are plain scans."""
    rows = spark.range(4000).select("id", F.concat(F.lit("w"), F.col("id") % 3, F.when(F.col("id").isin(17, 3333), " rare").otherwise("")).alias("message"))
    logs = laid_out(rows, "id", 64, str(tmp_path / "logs"))
    index = InvertedIndex.build(logs, "id", "message", str(tmp_path / "index"), 64)
    assert index.violations().count() == 0 and index.total_dictionary_size() == build_index(logs, "id", "message", 64).count()
    found = search(logs, "id", "message", Token("rare"), index)
    assert sorted(r.id for r in found.collect()) == [17, 3333]
    pushed = found._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(id,0)" in pushed and "LessThan(id,64)" in pushed and "GreaterThanOrEqual(id,3328)" in pushed
    assert search(logs, "id", "message", Token("none"), index).count() == 0
    assert "GreaterThan" not in search(logs, "id", "message", ~Token("rare"), index)._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1]
    assert search(logs, "id", "message", AnyTokens(["w1", "rare"]), index).count() == 1333 + 2
    both = search(logs, "id", "message", AllTokens(["w2", "rare"]) & ~Token("w0"), index)
    assert [r.id for r in both.collect()] == [17]


def test_row_groups_of_terms(table, index):
    """By files and by a job alike; terms in too many row groups are left out."""
    by_job = InvertedIndex(index.table, 4)
    assert index._files is not None and by_job._files is None
    for terms, most in (([], 2), (["a"], 2), (["a"], 1), (["a", "b", "none", "x" * 500], 1), (["a", "b", "c", "none"], 5)):
        want = {t: {g for g, w in brute() if w == t} for t in terms}
        want = {t: g for t, g in want.items() if len(g) <= most}
        assert index.groups_of(terms, most) == by_job.groups_of(terms, most) == want


@pytest.mark.parametrize("groups,most,ranges", [(set(), 3, []), ({1, 2, 5}, 3, [(1, 3), (5, 6)]), ({1, 4, 5, 90, 95}, 2, [(1, 6), (90, 96)]), ({1, 9}, 1, [(1, 10)])])
def test_ranges(groups, most, ranges):
    assert _ranges(groups, most) == ranges


def test_ranged_build_has_one_shuffle(table):
    plan = build_index(table, "id", "message", 4, ranged=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
