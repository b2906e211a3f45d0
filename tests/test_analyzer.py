import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokensift import BindError, analyze, is_ascii
from tokensift.functions.analyzer import analyze_literal


def brute(s):
    out, own = [], ""
    for c in s:
        if c in " \t\n\x0b\x0c\r":
            if own:
                out.append(own)
            own = ""
        else:
            own += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out + [own] if own else out


TEXTS = [
    "", "   ", "\t\n\x0b\x0c\r ", "one", " Two  WORDS ", "a\tb\nc\x0bd\x0ce\rf", "a\x08b\x0ec\x1fd", "x.y,z; (q) \"r\"", "A\x00B c", "GET /a?b=C HTTP/1.1", "a a A a", "Z" * 4000,
    " ".join(f"Word{i}" for i in range(69)), "[ERROR] Foo::bar(12): it's-broken",
]


def test_terms(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(-1, None)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", analyze("t").alias("a")).collect()}
    assert got.pop(-1) is None
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert [analyze_literal(t) for t in TEXTS] == [brute(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127), max_size=40))
def test_literal_like_brute_force(text):
    assert analyze_literal(text) == brute(text)


def test_random_documents(spark):
    import random

    r = random.Random(5)
    texts = ["".join(r.choice("aAbZ \t\n\x0b\x1f\x00.'") for _ in range(r.randrange(30))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {x.i: x.a for x in df.select("i", analyze("t").alias("a")).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_non_ascii(spark):
    df = spark.createDataFrame([(0, "plain"), (1, "café"), (2, None)], "i int, t string")
    assert [r.a for r in df.orderBy("i").select(is_ascii("t").alias("a")).collect()] == [True, False, None]
    assert [r.a for r in df.orderBy("i").select(analyze("t", "null").alias("a")).collect()] == [["plain"], None, None]
    with pytest.raises(Exception, match="ASCII"):
        df.select(analyze("t")).collect()
    with pytest.raises(BindError):
        analyze_literal("café")
    with pytest.raises(BindError):
        analyze("t", "ignore")
