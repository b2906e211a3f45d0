import unicodedata

import pytest
from pyspark.sql import functions as F

from tokensift.llm.lookalikes import _PASSED_OVER, _RANGES, _chars, _form, canonical_forms, lookalike_form, matches

SAME = [
    ("disk full", ["ｄｉｓｋ　ｆｕｌｌ", "disk full", "d​isk﻿ full⁠", "dіѕk full", "disk ful­l", "𝐝𝐢𝐬𝐤 full", "disk full‎"]),
    ("Disk full", ["Disk　full", "Ｄisk full"]),
    ("résumé job", ["résumé job", "résumé job", "rе́sumé job"]),
    ("mail off", ["mail oﬀ", "mаil оff"]),
    ("phiên việc", ["phiên việc", "phiên việc", "phiên việc"]),
    ("диск ёж й", ["диcк ёж й", "диск ëж й"]),
    ("ο δίσκος", ["o δίσκος"]),
    ("ディスク", ["ﾃﾞｨｽｸ", "ディスク"]),
    ("write-ahead", ["write‑ahead", "write‐ahead"]),
    ("bağlantı", ["bağlantı"]),
]
OTHER = ["disk ful", "DISK FULL", "resume job", "resumé job", "bağlanti", "диск еж й", "disk  full", "disk full!", "ο δισκος", "phiên viêc", "ディスグ", "mail of"]


def test_forms():
    for known, alike in SAME:
        assert {lookalike_form(x) for x in [known, *alike]} == {lookalike_form(known)}
    forms = {lookalike_form(k) for k, _ in SAME}
    assert len(forms) == len(SAME) and not forms & {lookalike_form(x) for x in OTHER}
    assert lookalike_form("​﻿") == "" and lookalike_form("") == ""


def test_forms_are_stable():
    for r in _RANGES:
        for p in r:
            c = "a" + chr(p) + "b"
            assert lookalike_form(lookalike_form(c)) == lookalike_form(c)


def test_collation_passes_over_nothing_invisible(spark):
    df = spark.createDataFrame([(chr(p),) for r in _RANGES for p in r if unicodedata.category(chr(p)) != "Cn"], "c string").select("c", F.concat(F.lit("a"), "c", F.lit("b")).alias("t"))
    left = df.withColumn("f", _form("t", [chr(p) for r in _RANGES for p in r])).where("f <> 'ab' AND collate(f, 'UNICODE') = collate('ab', 'UNICODE')").collect()
    assert all(unicodedata.category(r.c)[0] == "M" or r.c in _PASSED_OVER for r in left)


def test_mapping_equals_the_brute_force_form(spark):
    """The built-in functions give what mapping and normalising text by text gives, accents composed."""
    logs = spark.read.parquet("/root/testdata/sf0.001/logs.parquet").select("message").unionByName(spark.createDataFrame([(x,) for k, alike in SAME for x in [k, *alike]] + [(None,), ("a\tb\u2003c\x00\U0001d400\U000e0041",)], "message string"))
    got = logs.select("message", _form("message", _chars(logs)).alias("form")).where("message IS NOT NULL").collect()
    assert len(got) > 900 and all(unicodedata.normalize("NFC", r.form) == lookalike_form(r.message) for r in got)


@pytest.mark.parametrize("one,other", [("\u0133", "ij"), ("\u2163", "IV"), ("\u13aa", "A"), ("\u03ba", "k"), ("\ua4d0", "B"), ("\u01c6", "d\u017e"), ("\u2c9f", "o")])
def test_joined_letters_and_other_scripts(one, other):
    assert lookalike_form(f"x{one}y") == lookalike_form(f"x{other}y")


@pytest.mark.parametrize("one,other", [("\u00b2", "2"), ("\u00bd", "1/2"), ("\u2460", "1"), ("\u017f", "s"), ("\u0131", "i"), ("\u00f8", "o"), ("\u03d1", "\u03b8"), ("\ufb05", "st")])
def test_what_can_be_seen_stays(one, other):
    assert lookalike_form(f"x{one}y") != lookalike_form(f"x{other}y")


def test_one_message_of_most_rows(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 != 0, "caf\u00e9 au lait").when(F.col("id") % 20 == 0, "cafe\u0301 au lait").otherwise(F.concat(F.lit("\u00e9"), F.col("id").cast("string"))).alias("m"))
    got = canonical_forms(df, "m")
    assert got.count() == 5000 and {r.canonical for r in got.where("m LIKE 'caf%'").collect()} == {"caf\u00e9 au lait"}


def test_matches(spark):
    rows = [(known, i) for i, (known, _) in enumerate(SAME)] + [(x, i) for i, (_, alike) in enumerate(SAME) for x in alike]
    rows += [(x, -1) for x in OTHER] + [(None, -1), ("", -1), ("​", -1), (SAME[0][1][0], 0)]
    logs = spark.createDataFrame([(n, text, i, 1) for n, (text, i) in enumerate(rows)], "row_id int, message string, want int, canonical_ int").repartition(3)
    known = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(SAME)], "message_id int, message string")
    got = {(r.row_id, r.message_id) for r in matches(logs, "message", known, "message").collect()}
    names = {k for k, _ in SAME}
    assert got == {(n, i) for n, (text, i) in enumerate(rows) if i >= 0 and text not in names}


def test_canonical_forms(spark):
    texts = ["disk full", "ｄisk full", "é", "é", "é", None, "", "​", "x" * 50_000 + "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.canonical for r in canonical_forms(df, "text").collect()}
    assert len(got) == len(texts) and got[0] == got[1] == "disk full" and got[2] == got[3] == got[4] == "é"
    assert got[5] is None and got[6] == got[7] == "" and got[8] == texts[8]
    assert canonical_forms(df.limit(0), "text").count() == 0


def test_marks_that_can_be_seen_stay_apart(spark):
    df = spark.createDataFrame([(0, "שלום"), (1, "ש֑לום")], "id int, text string")
    got = {r.id: r.canonical for r in canonical_forms(df, "text").collect()}
    assert got[0] != got[1]


@pytest.mark.parametrize("member", ["ο δίσκος", "zzz"])
def test_catalogue_member_is_preferred(spark, member):
    df = spark.createDataFrame([(0, "o δίσκος")], "id int, text string")
    known = spark.createDataFrame([(member,)], "m string")
    assert canonical_forms(df, "text", known).first().canonical == (member if member != "zzz" else "o δίσκος")
