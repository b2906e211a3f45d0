import pytest
from pyspark.sql import functions as F

from tokensift import BindError, contains_all_tokens, contains_any_tokens, contains_token

ROWS = [(0, "alice met bob"), (1, "Alice and CAROL"), (2, "alicebob"), (3, "bob"), (4, None), (5, ""), (6, "   "), (7, "the and of"), (8, "alice\tbob\ncarol")]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(ROWS, "id int, msg string").cache()


def values(df, p):
    return {r.id: r.p for r in df.select("id", p.alias("p")).collect()}


def brute(d, ts, how):
    if d is None:
        return None
    words = d.lower().split()
    return how(not t.split() or t.split()[0].lower() in words for t in ts)


@pytest.mark.parametrize("token", ["alice", "ALICE", " Bob\t", "ali", "", "  ", "carol", "zzz"])
def test_token(logs, token):
    assert values(logs, contains_token("msg", token)) == {i: brute(d, [token], all) for i, d in ROWS}


@pytest.mark.parametrize("tokens", [[], ["alice"], ["alice", "bob"], ["ALICE", "alice"], ["", "bob"], ["the", "and", "of"], ["zzz", "bob"], ("alice", "carol")])
def test_lists(logs, tokens):
    assert values(logs, contains_all_tokens("msg", tokens)) == {i: brute(d, tokens, all) for i, d in ROWS}
    assert values(logs, contains_any_tokens("msg", tokens)) == {i: brute(d, tokens, any) for i, d in ROWS}


def test_long_lists(logs):
    many = [f"w{i}" for i in range(20)]
    for tokens in (many, [*many, "bob"], ["alice", "bob", "met"] * 9, ["Alice", "", *many]):
        assert values(logs, contains_all_tokens("msg", tokens)) == {i: brute(d, tokens, all) for i, d in ROWS}
        assert values(logs, contains_any_tokens("msg", tokens)) == {i: brute(d, tokens, any) for i, d in ROWS}


def test_terms_of_any_characters(spark):
    odd = ["a.b", "a+b", "[x]", "\\\\E", "\\\\Q", "$1", "^", "a\x00b", "\x1f", "it's", "(", "|", "\"q\"", "x\x08y", "{1}", "#", "-", "~"]
    rows = list(enumerate([*odd, *(f"pre {t} post" for t in odd), *(f"{t}z" for t in odd), *(f"z{t}" for t in odd), "axb aab x 1", ""]))
    df = spark.createDataFrame(rows, "id int, msg string").cache()
    for t in odd:
        assert values(df, contains_token("msg", t)) == {i: brute(d, [t], all) if "\x1f" not in d + t else t in d.split(" ") for i, d in rows}


def test_identities(logs):
    a, b = contains_token("msg", "alice"), contains_token("msg", "bob")
    both, either = contains_all_tokens("msg", ["alice", "bob"]), contains_any_tokens("msg", ["alice", "bob"])
    for x, y in ((both, a & b), (either, a | b), (~both, ~a | ~b), (~either, ~a & ~b)):
        assert logs.where(~x.eqNullSafe(y)).count() == 0


def test_null_arguments(logs):
    for p in (contains_token("msg", None), contains_token(None, "a b"), contains_all_tokens("msg", None), contains_any_tokens(None, ["a"])):
        assert set(values(logs, p).values()) == {None}


@pytest.mark.parametrize("call", [
    lambda: contains_token("msg", "two words"), lambda: contains_token("msg", "a\tb"), lambda: contains_token("msg", "café"), lambda: contains_token("msg", F.col("id")), lambda: contains_token("msg", 42),
    lambda: contains_all_tokens("msg", ["a", None]), lambda: contains_any_tokens("msg", ["a b"]), lambda: contains_all_tokens("msg", F.array(F.lit("a"))), lambda: contains_any_tokens("msg", "alice"),
    lambda: contains_all_tokens("msg", [42]), lambda: contains_token("msg", "a", non_ascii="skip"),
])
def test_bad_arguments_fail_at_once(spark, call):
    with pytest.raises(BindError):
        call()


def test_non_ascii_rows(spark):
    df = spark.createDataFrame([(0, "naïve alice"), (1, "alice")], "id int, msg string")
    for p in (contains_token("msg", "alice"), contains_token("msg", ""), contains_all_tokens("msg", []), contains_any_tokens("msg", [""])):
        with pytest.raises(Exception, match="ASCII"):
            df.select(p).collect()
    assert values(df, contains_token("msg", "alice", "null")) == {0: None, 1: True}


def test_aggregates(logs):
    p = contains_token("msg", "alice")
    assert logs.agg(F.count_if(p).alias("n")).first().n == 3
    assert {r.p: r["count"] for r in logs.groupBy(p.alias("p")).count().collect()} == {True: 3, False: 5, None: 1}
