from collections import Counter

import pytest

from oracle import same
from tokensift.llm import queries as llm

FOLDER = "/root/testdata/sf0.001"


ORACLE = llm.oracle_sql()


@pytest.mark.parametrize("name", list(ORACLE))
def test_against_sql(spark, name):
    same(llm.QUERIES[name](spark, FOLDER), ORACLE[name], FOLDER)


#: Queries that SQL cannot express, and where each is held against brute force, the library or a whole count.
ELSEWHERE = {
    "p6_ids": "test_tokens.test_whole_documents_like_the_library", "p6_offsets": "test_tokens.test_whole_documents_like_the_library",
    "p7_found": "test_leaks.test_against_all_pairs", "p7_leaked_items": "test_leaked_items", "p8_found": "test_spam.test_stuffing_against_brute_force", "p8_scores": "test_spam.test_pages",
}


def test_every_query_is_held_against_something():
    assert set(llm.QUERIES) == set(ORACLE) | set(ELSEWHERE)


def test_leaked_items(spark):
    found = Counter(r.item_id for r in llm.QUERIES["p7_found"](spark, FOLDER).collect())
    rows = {r.item_id: (r.n_documents, r.largest_share) for r in llm.QUERIES["p7_leaked_items"](spark, FOLDER).collect()}
    assert {i: n for i, (n, _) in rows.items()} == found and all(0.4 <= share <= 1 for _, share in rows.values())


def test_spam_is_a_reading_of_the_scores(spark):
    scores = {r.doc_id for r in llm.QUERIES["p8_scores"](spark, FOLDER).collect() if r.list_share > 0.5 and r.stitched_share > 0.5}
    assert {r.doc_id for r in llm.QUERIES["p8_found"](spark, FOLDER).collect()} == scores


def test_columns(spark):
    want = {"p1_found": ["row_group", "term"], "p2_found": ["term"], "p4_found": ["term", "mark"], "p5_found": ["row_id", "message_id"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}
    for name, columns in want.items():
        assert llm.QUERIES[name](spark, FOLDER).columns == columns
    assert dict(llm.QUERIES["p6_ids"](spark, FOLDER).dtypes)["ids"] == "array<int>"
