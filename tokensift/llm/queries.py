"""The queries of problems 1, 2 and 4 to 8, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensift.llm import burst_trie, enrichment, heavy_hitters, leaks, lookalikes, spam, tokens
from tokensift.sources.tables import table


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "term_postings", "row_group", "term", "postings")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sstable_dict_entry", "row_group", "term", "postings_count")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scored = enrichment.distinctive_terms(_postings(spark, d), _entries(spark, d))
    return enrichment.characteristic_terms(scored, min_rows=12, percent=80).select("row_group", "term")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = enrichment.distinctive_terms(_postings(spark, d), _entries(spark, d))
    return scored.select("row_group", "term", "k", "total", "n", F.round(F.abs("score"), 3).alias("score"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters.top_values(table(spark, d, "posting_inserts", "term"), "term", 15).select(F.col("value").alias("term"))


def p2_frequent(spark: SparkSession, d: str) -> DataFrame:
    """All terms with more than a thousandth of the rows."""
    return heavy_hitters.frequent_values(table(spark, d, "posting_inserts", "term"), "term", 1000).withColumnRenamed("value", "term")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    postings = _postings(spark, d)
    counts = burst_trie.term_frequencies(postings, _entries(spark, d))
    return burst_trie.mark_terms(counts, burst_trie.indexed_rows(postings)).where("mark is not null").select("term", "mark")


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return burst_trie.term_frequencies(_postings(spark, d), _entries(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "known_messages", "message_id", "message")
    return lookalikes.matches(table(spark, d, "logs", "row_id", "message"), "message", known, "message").select("row_id", "message_id")


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every message in its consistent form."""
    return lookalikes.canonical_forms(table(spark, d, "logs", "row_id", "message"), "message").select("row_id", "canonical")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents", "doc_id", "text"))


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_offsets(table(spark, d, "documents", "doc_id", "text"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The texts after encoding and decoding, as their lengths and hashes."""
    back = tokens.decode_ids(tokens.encode_texts(table(spark, d, "documents", "doc_id", "text")))
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("md5"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    documents, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "passage")
    return leaks.find_leaks(documents, items).select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents leak each item, and the largest part of it that one holds."""
    documents, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "passage")
    return leaks.find_leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.round(F.max("share"), 6).alias("largest_share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(spam.page_scores(table(spark, d, "documents", "doc_id", "text", "source"))).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.page_scores(table(spark, d, "documents", "doc_id", "text", "source"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_scores, p2_found, p2_frequent, p4_found, p4_frequencies, p5_found, p5_canonical,
              p6_ids, p6_offsets, p6_round_trip, p7_found, p7_leaked_items, p8_found, p8_scores)
}

_PAIRS = """
pairs AS (SELECT row_group, term, max(postings_count)::BIGINT AS k FROM sstable_dict_entry
          WHERE term IS NOT NULL AND postings_count > 0 GROUP BY row_group, term),
totals AS (SELECT term, sum(k)::BIGINT AS total FROM pairs GROUP BY term)"""



# problem 5, told apart from the operator: the kinds of changes that TESTDATA.md names, character by character

_BLANK = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
_UNSEEN = "".join(map(chr, [0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF]))
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ORDINARY = "".join(map(chr, range(0x21, 0x7F)))
_NARROW, _KANA = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ", "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a"
_SHAPES = (
    ("аеорсхуіѕјԁһԛԝАВЕКМНОРСТХ", "aeopcxyisjdhqwABEKMHOPCTX"), ("ёЁѐ", "ëËè"), ("ονρκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpkABEZHIKMNOPTYX"), ("όϊ", "óϊ"), ("ոօսɡɑ‐‑µ", "nouga--μ"),
)


def _form_sql(c: str) -> str:
    """The mapped text; accents may still stand apart."""
    pairs = [(_BLANK, " " * len(_BLANK)), (_WIDE, _ORDINARY), (_NARROW, _KANA), *_SHAPES]
    out = f"translate({c}, {_text(''.join(a for a, _ in pairs) + _UNSEEN)}, {_text(''.join(b for _, b in pairs))})"
    for one, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = f"replace({out}, '{one}', '{letters}')"
    return out


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE = {
    "p1_found": f"""
WITH {_PAIRS}
SELECT row_group, term FROM pairs JOIN totals USING (term) WHERE k >= 12 AND k * 100 >= total * 80""",
    "p1_scores": f"""
WITH {_PAIRS},
sizes AS (SELECT row_group, count(DISTINCT row_id) AS n
          FROM (SELECT row_group, unnest(postings) AS row_id FROM term_postings WHERE term IS NOT NULL)
          WHERE row_id IS NOT NULL GROUP BY row_group),
whole AS (SELECT sum(n)::BIGINT AS big FROM sizes),
f AS (SELECT row_group, term, k, total, n, big FROM pairs JOIN totals USING (term) JOIN sizes USING (row_group) CROSS JOIN whole),
c AS (SELECT k, total, n, big, count(*) AS pairs FROM f GROUP BY ALL),
t AS (SELECT *, lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1)
             + lgamma(big - total + 1) - lgamma(n - i + 1) - lgamma(big - total - n + i + 1)
             - lgamma(big + 1) + lgamma(n + 1) + lgamma(big - n + 1) AS lp
      FROM (SELECT *, unnest(range(k, least(total, n) + 1)) AS i FROM c) WHERE n - i <= big - total),
m AS (SELECT k, total, n, big, pairs, max(lp) AS mx FROM t GROUP BY ALL),
p AS (SELECT m.k, m.total, m.n, m.pairs,
             CASE WHEN m.k <= greatest(0, m.n + m.total - m.big) THEN 0.0 ELSE least(0.0, m.mx + ln(sum(exp(t.lp - m.mx)))) END AS lp
      FROM m JOIN t USING (k, total, n) GROUP BY m.k, m.total, m.n, m.big, m.pairs, m.mx),
r AS (SELECT *, lp + ln(sum(pairs) OVER () / sum(pairs) OVER (ORDER BY lp)) AS raw FROM p),
q AS (SELECT k, total, n, least(0.0, min(raw) OVER (ORDER BY lp DESC)) AS lq FROM r)
SELECT row_group, term, k, total, n, round(abs(lq), 3) AS score FROM f JOIN q USING (k, total, n)""",
    "p2_found": """
SELECT term FROM posting_inserts WHERE term IS NOT NULL GROUP BY term ORDER BY count(*) DESC, term LIMIT 15""",
    "p2_frequent": """
SELECT term, count(*) AS n FROM posting_inserts WHERE term IS NOT NULL GROUP BY term
HAVING count(*) * 1000 > (SELECT count(term) FROM posting_inserts)""",
    "p4_found": """
WITH pairs AS (SELECT DISTINCT term, row_id FROM (SELECT term, unnest(postings) AS row_id FROM term_postings WHERE term IS NOT NULL)
               WHERE row_id IS NOT NULL),
n AS (SELECT count(DISTINCT row_id) AS n FROM pairs),
c AS (SELECT term, count(*) AS c FROM pairs GROUP BY term)
SELECT term, CASE WHEN c = 1 THEN 'rare' ELSE 'common' END AS mark FROM c, n WHERE c = 1 OR c * 10 >= n""",
    "p4_frequencies": """
WITH occ AS (SELECT term, sum(coalesce(len(postings), 0))::BIGINT AS occurrences FROM term_postings WHERE term IS NOT NULL GROUP BY term),
rows_ AS (SELECT term, sum(c)::BIGINT AS n_rows FROM (SELECT row_group, term, max(postings_count) AS c FROM sstable_dict_entry
          WHERE term IS NOT NULL GROUP BY row_group, term) GROUP BY term)
SELECT term, coalesce(occurrences, 0) AS occurrences, coalesce(n_rows, 0) AS n_rows FROM occ FULL JOIN rows_ USING (term)""",
    "p6_round_trip": """
SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS md5 FROM documents""",
}


ORACLE["p5_found"] = f"""
WITH k AS (SELECT message_id, message AS known, nfc_normalize({_form_sql('message')}) AS form FROM known_messages),
m AS (SELECT row_id, message, nfc_normalize({_form_sql('message')}) AS form FROM logs)
SELECT row_id, message_id FROM m JOIN k USING (form) WHERE message <> known"""
ORACLE["p5_canonical"] = f"""
WITH m AS (SELECT row_id, message, {_form_sql('message')} AS mapped FROM logs),
f AS (SELECT *, nfc_normalize(mapped) AS form FROM m),
c AS (SELECT form, min({{'changed': mapped <> message, 'size': length(message), 'text': message}}).text AS first FROM f GROUP BY form)
SELECT row_id, CASE WHEN regexp_full_match(form, '[ -~]*') THEN form ELSE first END AS canonical FROM f LEFT JOIN c USING (form)"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
