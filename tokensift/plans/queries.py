"""Queries of the core, and their SQL.

Texts outside ASCII have no terms defined; queries over mixed tables give null for them (``non_ascii='null'``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensift.functions.analyzer import analyze, is_ascii
from tokensift.functions.predicates import contains_all_tokens, contains_any_tokens, contains_token
from tokensift.operators import eager
from tokensift.operators.catalog import TokenEngine
from tokensift.operators.index import InvertedIndex, build_index
from tokensift.operators.search import AllTokens, AnyTokens, Predicate, Token, Where, as_condition, search
from tokensift.plans.sql import TokenSQL
from tokensift.sources.tables import laid_out, materialized, table, work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    """Adds a query, named after its function, and its SQL."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# SQL of the analyzer and the predicates: A(c), null for texts outside ASCII

def _ascii(c: str) -> str:
    return f"CASE WHEN strlen({c}) = length({c}) THEN {c} END"


def _terms(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({_ascii(c)}), '[\\x09-\\x0D ]+'), lambda t: t <> '')"


def _token(c: str, t: str) -> str:
    return f"list_contains({_terms(c)}, '{t}')"


def _all(c: str, *ts: str) -> str:
    return "(" + " AND ".join(_token(c, t) for t in ts) + ")"


def _any(c: str, *ts: str) -> str:
    return "(" + " OR ".join(_token(c, t) for t in ts) + ")"


_EV = "(SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type || ' ' || props END AS m FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events", "event_id", "event_type", "props")
    return ev.withColumn("m", F.when(F.col("event_id") % 7 != 0, F.concat("event_type", F.lit(" "), "props")))


def _logs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "logs", "row_id", *columns)


# scans

@_query(f"SELECT row_id FROM logs WHERE {_token('message', 'error')}")
def ct_scan(spark, d):
    return _logs(spark, d, "message").where(contains_token("message", "ERROR", "null")).select("row_id")


@_query(f"SELECT row_id FROM logs WHERE {_token('message', 'status=200')}")
def ct_rare(spark, d):
    return _logs(spark, d, "message").where(contains_token("message", " Status=200\t", "null")).select("row_id")


@_query(f"SELECT count(*) AS n FROM logs WHERE {_token('message', 'zzzabsent')}")
def ct_absent(spark, d):
    return _logs(spark, d, "message").where(contains_token("message", "zzzabsent", "null")).agg(F.count("*").alias("n"))


@_query(f"SELECT event_id, CASE WHEN m IS NOT NULL THEN TRUE END AS hit FROM {_EV}")
def ct_empty_token(spark, d):
    return _events(spark, d).select("event_id", contains_token("m", "  ").alias("hit"))


@_query(f"SELECT event_id, {_token('m', 'error')} AS hit FROM {_EV}")
def ct_projection(spark, d):
    return _events(spark, d).select("event_id", contains_token("m", "ERROR").alias("hit"))


@_query("SELECT event_id, CAST(NULL AS BOOLEAN) AS hit FROM events")
def ct_null_token(spark, d):
    return _events(spark, d).select("event_id", contains_token("m", None).alias("hit"))


@_query(f"SELECT doc_id FROM documents WHERE {_token('text', 'captain')}")
def ct_documents(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where(contains_token("text", "captain", "null")).select("doc_id")


@_query(f"SELECT row_id FROM logs WHERE {_all('message', 'request', 'from', 'in')}")
def all_scan(spark, d):
    return _logs(spark, d, "message").where(contains_all_tokens("message", ["in", "From", "request"], "null")).select("row_id")


@_query(f"SELECT row_id FROM logs WHERE {_any('message', 'retry', 'panic', '=>')}")
def any_scan(spark, d):
    return _logs(spark, d, "message").where(contains_any_tokens("message", ["RETRY", "panic", "=>"], "null")).select("row_id")


@_query(f"SELECT event_id, CASE WHEN m IS NOT NULL THEN TRUE END AS hit FROM {_EV}")
def all_empty(spark, d):
    return _events(spark, d).select("event_id", contains_all_tokens("m", []).alias("hit"))


@_query(f"SELECT event_id, CASE WHEN m IS NOT NULL THEN FALSE END AS hit FROM {_EV}")
def any_empty(spark, d):
    return _events(spark, d).select("event_id", contains_any_tokens("m", []).alias("hit"))


@_query(f"SELECT event_id, CASE WHEN m IS NOT NULL THEN TRUE END AS hit FROM {_EV}")
def any_vacuous(spark, d):
    return _events(spark, d).select("event_id", contains_any_tokens("m", ["", "zzz"]).alias("hit"))


@_query(f"SELECT count(*) AS n FROM part WHERE {_all('p_name', 'red', 'red')} IS DISTINCT FROM {_token('p_name', 'red')}")
def all_dedup(spark, d):
    p = table(spark, d, "part", "p_name")
    both = contains_all_tokens("p_name", ["red", "RED"]), contains_all_tokens("p_name", ["red"])
    return p.where(~both[0].eqNullSafe(both[1])).agg(F.count("*").alias("n"))


# composition

@_query(f"SELECT p_partkey FROM part WHERE ({_token('p_name', 'cold')} OR {_token('p_name', 'red')}) AND ({_token('p_name', 'gear')} OR {_token('p_name', 'ring')})")
def and_or_nested(spark, d):
    tree = (Token("cold") | Token("red")) & (Token("gear") | Token("ring"))
    return table(spark, d, "part", "p_partkey", "p_name").where(as_condition(tree, "p_name")).select("p_partkey")


@_query(f"SELECT o_orderkey FROM orders WHERE {_token('o_orderpriority', '4-not')} OR {_token('o_orderstatus', 'f')}")
def cross_column(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return o.where(contains_token("o_orderpriority", "4-NOT") | contains_token("o_orderstatus", "f")).select("o_orderkey")


@_query(f"SELECT row_id FROM logs WHERE {_token('message', 'cache')} OR {_token('note', 'duplicate')}")
def cross_column_logs(spark, d):
    logs = _logs(spark, d, "message", "note")
    return logs.where(contains_token("message", "cache", "null") | contains_token("note", "duplicate", "null")).select("row_id")


@_query(f"SELECT p_partkey FROM part WHERE {_token('p_name', 'gear')} AND p_size > 20")
def mixed_filter(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name", "p_size").where(contains_token("p_name", "gear") & (F.col("p_size") > 20)).select("p_partkey")


@_query(f"SELECT event_id FROM {_EV} WHERE NOT {_token('m', 'error')}")
def not_token(spark, d):
    return _events(spark, d).where(~contains_token("m", "error")).select("event_id")


@_query(f"SELECT row_id FROM logs WHERE {_token('message', 'info')} AND NOT {_token('message', 'get')} AND note IS NOT NULL")
def and_not(spark, d):
    logs = _logs(spark, d, "message", "note")
    return logs.where(contains_token("message", "info", "null") & ~contains_token("message", "get", "null") & F.col("note").isNotNull()).select("row_id")


@_query(f"SELECT event_id, p, p AND FALSE AS and_false, p AND TRUE AS and_true, p OR FALSE AS or_false, p OR TRUE AS or_true, NOT p AS not_p FROM (SELECT event_id, {_token('m', 'error')} AS p FROM {_EV})")
def tvl(spark, d):
    p = F.col("p")
    return _events(spark, d).select("event_id", contains_token("m", "error").alias("p")).select(
        "event_id", "p", (p & F.lit(False)).alias("and_false"), (p & F.lit(True)).alias("and_true"), (p | F.lit(False)).alias("or_false"), (p | F.lit(True)).alias("or_true"), (~p).alias("not_p"))


@_query(f"SELECT count(*) AS n FROM {_EV} WHERE (NOT {_all('m', 'error', 'view')}) IS DISTINCT FROM (NOT {_token('m', 'error')} OR NOT {_token('m', 'view')})")
def de_morgan(spark, d):
    a, b = contains_token("m", "error"), contains_token("m", "view")
    return _events(spark, d).where(~(~contains_all_tokens("m", ["error", "view"])).eqNullSafe(~a | ~b)).agg(F.count("*").alias("n"))


@_query(f"SELECT hit, count(*) AS n FROM (SELECT {_token('m', 'error')} AS hit FROM {_EV}) GROUP BY hit")
def group_by_pred(spark, d):
    return _events(spark, d).groupBy(contains_token("m", "error").alias("hit")).agg(F.count("*").alias("n"))


@_query(f"SELECT count(*) FILTER ({_token('m', 'error')}) AS yes, count(*) FILTER (NOT {_token('m', 'error')}) AS no FROM {_EV}")
def count_filter(spark, d):
    p = contains_token("m", "error")
    return _events(spark, d).agg(F.count_if(p).alias("yes"), F.count_if(~p).alias("no"))


@_query(f"SELECT component FROM (SELECT component, {_token('message', 'app=tern')} AS p FROM logs) GROUP BY component HAVING bool_or(p) AND NOT bool_and(p)")
def having_bool(spark, d):
    logs = _logs(spark, d, "component", "message").select("component", contains_token("message", "app=tern", "null").alias("p"))
    return logs.groupBy("component").agg(F.bool_or("p").alias("any"), F.bool_and("p").alias("every")).where(F.col("any") & ~F.col("every")).select("component")


@_query(f"SELECT event_id, coalesce({_token('m', 'error')}, FALSE) AS hit FROM {_EV}")
def coalesce_pred(spark, d):
    return _events(spark, d).select("event_id", F.coalesce(contains_token("m", "error"), F.lit(False)).alias("hit"))


@_query(f"SELECT event_id FROM {_EV} WHERE event_id % 7 = 3 AND {_any('m', 'error', 'zzz')}")
def modulo_filter(spark, d):
    return _events(spark, d).where((F.col("event_id") % 7 == 3) & contains_any_tokens("m", ["error", "zzz"])).select("event_id")


@_query(f"SELECT CASE WHEN {_token('m', 'error')} THEN 'error' WHEN m IS NULL THEN 'none' ELSE 'other' END AS kind, count(*) AS n FROM {_EV} GROUP BY kind")
def case_pred(spark, d):
    kind = F.when(contains_token("m", "error"), "error").when(F.col("m").isNull(), "none").otherwise("other")
    return _events(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@_query(f"SELECT p_partkey FROM part WHERE {_token('p_name', 'gear')} ORDER BY p_partkey DESC LIMIT 10")
def top_matches(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name").where(contains_token("p_name", "gear")).select("p_partkey").orderBy(F.desc("p_partkey")).limit(10)


@_query(f"SELECT p_partkey, unnest({_terms('p_name')}) AS term, unnest(range(len({_terms('p_name')})))::INT AS pos FROM part")
def analyze_terms(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.posexplode(analyze("p_name")).alias("pos", "term"))


@_query(f"SELECT row_id, len({_terms('message')}) AS n_terms FROM logs")
def analyze_lengths(spark, d):
    return _logs(spark, d, "message").select("row_id", F.when(F.col("message").isNotNull(), F.size(analyze("message", "null"))).cast("bigint").alias("n_terms"))


# SQL front end

def _sql(spark: SparkSession, d: str, text: str, **tables: str) -> DataFrame:
    engine = TokenEngine(spark)
    for name, key in tables.items():
        engine.register(name, table(spark, d, name), key)
    return TokenSQL(engine).sql(text)


@_query(f"SELECT p_partkey FROM part WHERE {_token('p_name', 'gear')} AND {_any('p_name', 'cold', 'red')}")
def sql_cte(spark, d):
    return _sql(spark, d, "WITH gears AS (SELECT * FROM part WHERE contains_token(p_name, 'GEAR')) SELECT p_partkey FROM gears WHERE contains_any_tokens(p_name, array('cold', 'red'))", part="p_partkey")


@_query(f"SELECT p_size, count(*) AS n FROM part WHERE {_token('p_name', 'gear')} GROUP BY p_size")
def sql_view(spark, d):
    engine = TokenEngine(spark)
    engine.register("part", table(spark, d, "part"), "p_partkey")
    front = TokenSQL(engine)
    front.sql("CREATE OR REPLACE TEMPORARY VIEW gears AS SELECT p_partkey, p_size FROM part WHERE contains_token(p_name, 'gear')")
    return front.sql("SELECT p_size, count(*) AS n FROM gears GROUP BY p_size")


@_query(f"SELECT o_orderpriority, {_token('o_orderpriority', '5-low')} AS low, count(*) AS n FROM orders GROUP BY ALL")
def sql_group(spark, d):
    return _sql(spark, d, "SELECT o_orderpriority, contains_token(o_orderpriority, concat('5-', 'LOW')) AS low, count(*) AS n FROM orders GROUP BY o_orderpriority", orders="o_orderkey")


@_query("SELECT * FROM (VALUES (0, TRUE), (1, FALSE), (2, CAST(NULL AS BOOLEAN)), (3, TRUE)) v(id, hit)")
def sql_values(spark, d):
    return _sql(spark, d, "SELECT id, contains_all_tokens(s, array('a', 'B')) AS hit FROM VALUES (0, 'b A'), (1, 'ab'), (2, NULL), (3, 'x\\ta\\nb') AS v(id, s)")


@_query(f"SELECT p_partkey, {_token('p_name', 'ring')} AS hit FROM part WHERE {_any('p_name', 'ring', 'gear')}")
def sql_ctas(spark, d):
    """A table made and filled by SQL."""
    name = f"hits_{uuid.uuid4().hex}"
    _sql(spark, d, f"CREATE TABLE {name} USING parquet LOCATION '{work_path(spark, name)}' AS SELECT p_partkey, contains_token(p_name, 'ring') AS hit FROM part WHERE contains_any_tokens(p_name, array('ring', 'GEAR'))", part="p_partkey")
    return spark.table(name)


@_query(f"SELECT p_partkey FROM part WHERE {_token('p_name', 'ring')} UNION ALL SELECT -p_partkey FROM part WHERE {_token('p_name', 'gear')}")
def sql_insert(spark, d):
    name = f"hits_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (p_partkey BIGINT) USING parquet LOCATION '{work_path(spark, name)}'")
    for key, token in (("p_partkey", "ring"), ("-p_partkey", "gear")):
        _sql(spark, d, f"INSERT INTO {name} SELECT {key} FROM part WHERE contains_token(p_name, '{token}')", part="p_partkey")
    return spark.table(name)


@_query(f"SELECT hit, count(*) AS n FROM (SELECT {_token('m', 'error')} AS hit FROM {_EV}) GROUP BY hit ORDER BY hit NULLS LAST")
def sql_nulls_last(spark, d):
    engine = TokenEngine(spark)
    engine.register("happened", _events(spark, d), "event_id")
    return TokenSQL(engine).sql("SELECT contains_token(m, 'error') AS hit, count(*) AS n FROM happened GROUP BY contains_token(m, 'error') ORDER BY hit NULLS LAST")


@_query("SELECT * FROM (VALUES ('by_message', 'logs', FALSE), ('by_note', 'logs', FALSE)) v(index_name, table_name, is_unique)")
def sql_listing(spark, d):
    engine = TokenEngine(spark)
    engine.register("logs", _logs(spark, d, "message", "note").where(is_ascii("message") & F.coalesce(is_ascii("note"), F.lit(True))), "row_id")
    front = TokenSQL(engine)
    front.sql("CREATE INDEX by_message ON logs USING tokens (message)")
    front.sql("CREATE INDEX by_note ON logs (note)")
    return front.sql("SELECT index_name, table_name, is_unique FROM duckdb_indexes()")


@_query("SELECT range AS id FROM range(5000) WHERE range % 1000 = 7")
def sql_range(spark, d):
    return _sql(spark, d, "SELECT id FROM (SELECT id, concat('row number ', CAST(id % 1000 AS STRING)) AS msg FROM range(5000)) WHERE contains_token(msg, '7')")


@_query(f"SELECT p_partkey, p_name FROM part WHERE {_token('p_name', 'ring')}")
def ctas_query(spark, d):
    """A table made from matching rows, written and read again."""
    return materialized(table(spark, d, "part", "p_partkey", "p_name").where(contains_token("p_name", "ring")), "ctas")


# the index

_IX = f"(SELECT row_id, unnest(list_distinct({_terms('message')})) AS term FROM logs)"
_GROUP = 256


def _index(spark: SparkSession, d: str) -> InvertedIndex:
    return InvertedIndex(materialized(build_index(_logs(spark, d, "message"), "row_id", "message", _GROUP, "null"), "index"), _GROUP)


def _searched(tree: Predicate) -> Query:
    def run(spark, d):
        return search(_logs(spark, d, "message", "note"), "row_id", "message", tree, _index(spark, d), "null", "join").select("row_id")

    return run


@_query(f"SELECT row_id // {_GROUP} AS row_group, term, list_sort(list(row_id)) AS row_ids, count(*) AS postings_count FROM {_IX} GROUP BY ALL")
def index_postings(spark, d):
    return build_index(_logs(spark, d, "message"), "row_id", "message", _GROUP, "null")


@_query(f"SELECT row_id FROM logs WHERE {_token('message', 'retry')}")
def index_lookup(spark, d):
    return _index(spark, d).lookup("retry")


for _name, _tree, _where in (
    ("index_search_token", Token("ERROR"), _token("message", "error")),
    ("index_search_all", AllTokens(["request", "from", "in"]), _all("message", "request", "from", "in")),
    ("index_search_any", AnyTokens(["retry", "panic", "=>"]), _any("message", "retry", "panic", "=>")),
    ("index_search_not", ~Token("app=tern"), f"NOT {_token('message', 'app=tern')}"),
    ("index_search_empty_token", Token(" "), f"{_ascii('message')} IS NOT NULL"),
    ("index_search_absent", AnyTokens(["zzzabsent", "retry"]) & ~Token("zzzabsent"), _token("message", "retry")),
    ("index_search_nested", (Token("error") | Token("warn")) & ~(Token("cache") | Token("get")), f"{_any('message', 'error', 'warn')} AND NOT {_any('message', 'cache', 'get')}"),
):
    QUERIES[_name], ORACLE[_name] = _searched(_tree), f"SELECT row_id FROM logs WHERE {_where}"


@_query(f"SELECT row_id FROM logs WHERE {_token('message', 'info')} AND note IS NOT NULL")
def index_search_filter(spark, d):
    return _searched(Token("info") & Where(F.col("note").isNotNull()))(spark, d)


@_query(f"SELECT row_id FROM logs WHERE {_token('message', 'retry')} OR note IS NOT NULL")
def index_search_mixed_or(spark, d):
    return _searched(Token("retry") | Where(F.col("note").isNotNull()))(spark, d)


@_query(f"SELECT row_id // {_GROUP} AS row_group, count(DISTINCT term) AS num_terms, min(row_id) AS min_row_id, max(row_id) AS max_row_id FROM {_IX} GROUP BY row_group")
def index_stats(spark, d):
    return _index(spark, d).partition_stats()


@_query(f"SELECT count(DISTINCT (row_id // {_GROUP}, term)) AS entries, count(DISTINCT term) AS terms, count(DISTINCT row_id // {_GROUP}) AS row_groups FROM {_IX}")
def index_total_dictionary(spark, d):
    index = build_index(_logs(spark, d, "message"), "row_id", "message", _GROUP, "null")
    return index.agg(F.count("*").alias("entries"), F.countDistinct("term").alias("terms"), F.countDistinct("row_group").alias("row_groups"))


@_query("SELECT count(*) AS n FROM (SELECT 1 WHERE FALSE)")
def index_violations(spark, d):
    return _index(spark, d).violations().agg(F.count("*").alias("n"))


@_query(f"SELECT event_id // 1024 AS row_group, term, list_sort(list(event_id)) AS row_ids, count(*) AS postings_count FROM (SELECT event_id, unnest(list_distinct({_terms('m')})) AS term FROM {_EV}) GROUP BY ALL")
def index_nulls(spark, d):
    return build_index(_events(spark, d), "event_id", "m", 1024)


@_query(f"SELECT source, count(*) AS n FROM documents WHERE {_token('text', 'the')} GROUP BY source")
def flagship(spark, d):
    """Index over all documents, a lookup, the semi join back and a count by source."""
    documents = table(spark, d, "documents", "doc_id", "text", "source")
    index = InvertedIndex(materialized(build_index(documents, "doc_id", "text", 1024, "null"), "index"), 1024)
    return search(documents, "doc_id", "text", Token("the"), index, "null", "join").groupBy("source").agg(F.count("*").alias("n"))


@_query("SELECT 'by_message' AS index_name, 'logs' AS table_name, 'message' AS column_name, FALSE AS is_unique")
def index_listing(spark, d):
    """Two indexes made, one dropped."""
    engine = TokenEngine(spark)
    engine.register("logs", _logs(spark, d, "message", "note"), "row_id")
    engine.create_index("by_message", "logs", "message", row_group_size=_GROUP, non_ascii="null")
    engine.create_index("by_note", "logs", "note", row_group_size=_GROUP, non_ascii="null")
    engine.create_index("by_note", "logs", "note", if_not_exists=True)
    engine.drop_index("by_note")
    return engine.indexes()


# the sealed index, and the scan that it narrows

def _sealed(spark: SparkSession, d: str) -> tuple[DataFrame, InvertedIndex]:
    """The logs laid out by row id, and their index as sealed on disk."""
    folder = work_path(spark, "sealed")
    logs = laid_out(_logs(spark, d, "message", "note"), "row_id", _GROUP, f"{folder}/rows")
    return logs, InvertedIndex.build(logs, "row_id", "message", f"{folder}/index", _GROUP, "null")


def _narrowed(tree: Predicate) -> Query:
    def run(spark, d):
        logs, index = _sealed(spark, d)
        return search(logs, "row_id", "message", tree, index, "null").select("row_id")

    return run


for _name, _tree, _where in (
    ("sealed_search_token", Token("panic"), _token("message", "panic")),
    ("sealed_search_all", AllTokens(["request", "from", "in"]), _all("message", "request", "from", "in")),
    ("sealed_search_any", AnyTokens(["retry", "panic", "=>"]), _any("message", "retry", "panic", "=>")),
    ("sealed_search_not", ~Token("app=tern"), f"NOT {_token('message', 'app=tern')}"),
    ("sealed_search_absent", Token("zzzabsent") | AllTokens(["zzzabsent", "error"]), _token("message", "zzzabsent")),
    ("sealed_search_nested", (Token("retry") | Token("panic")) & ~Token("error"), f"{_any('message', 'retry', 'panic')} AND NOT {_token('message', 'error')}"),
):
    QUERIES[_name], ORACLE[_name] = _narrowed(_tree), f"SELECT row_id FROM logs WHERE {_where}"


@_query(f"SELECT row_id FROM logs WHERE {_token('message', 'retry')}")
def sealed_lookup(spark, d):
    return _sealed(spark, d)[1].lookup("retry")


@_query(f"SELECT row_id // {_GROUP} AS row_group, term, list_sort(list(row_id)) AS row_ids, count(*) AS postings_count FROM {_IX} GROUP BY ALL")
def sealed_postings(spark, d):
    return _sealed(spark, d)[1].table


@_query(f"SELECT count(DISTINCT (row_id // {_GROUP}, term)) AS entries, count(DISTINCT row_id // {_GROUP}) AS row_groups FROM {_IX}")
def sealed_statistics(spark, d):
    index = _sealed(spark, d)[1]
    return spark.createDataFrame([(index.total_dictionary_size(), index.num_partitions())], "entries bigint, row_groups bigint")


@_query(f"""
WITH e AS (SELECT row_id // {_GROUP} AS g, term, count(*) AS n FROM {_IX} GROUP BY ALL)
SELECT 'row ids do not ascend' AS problem, count(*) FILTER (n > 1) AS n FROM e UNION ALL SELECT 'count differs from list', count(*) FROM e""")
def sealed_damage(spark, d):
    """What the audit finds in an index whose lists are turned round and whose counts are one too high."""
    index = _sealed(spark, d)[1]
    bad = index.table.withColumns({"row_ids": F.reverse("row_ids"), "postings_count": F.col("postings_count") + 1})
    found = InvertedIndex(bad, _GROUP).violations().where("problem <> 'row id outside its row group'")
    return found.groupBy("problem").agg(F.count("*").alias("n"))


# problem 3

def _postings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "term_postings", "row_group", "term", "postings")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sstable_dict_entry", "row_group", "term", "postings_count")


@_query("""
WITH pairs AS (SELECT DISTINCT term, row_id FROM (SELECT term, unnest(postings) AS row_id FROM term_postings WHERE term IS NOT NULL)
               WHERE row_id IS NOT NULL)
SELECT term FROM pairs GROUP BY term HAVING count(*) * 80 >= (SELECT count(*) FROM pairs)""")
def p3_found(spark, d):
    totals = materialized(eager.term_totals(_postings(spark, d), _entries(spark, d)), "term-totals")
    return eager.dominant_terms(totals, share=80).select("term")


@_query("""
WITH ids AS (SELECT term, count(DISTINCT row_id) AS n_rows FROM (
               SELECT term, unnest(postings) AS row_id FROM term_postings WHERE term IS NOT NULL) GROUP BY term),
records AS (SELECT term, count(*) AS n_records FROM term_postings WHERE term IS NOT NULL AND len(postings) > 0 GROUP BY term),
told AS (SELECT term, count(*) AS g, sum(c)::BIGINT AS c FROM (SELECT row_group, term, max(postings_count) AS c FROM sstable_dict_entry
         WHERE term IS NOT NULL AND postings_count > 0 GROUP BY row_group, term) GROUP BY term)
SELECT term, n_rows, n_records, coalesce(g, 0) AS n_row_groups, c AS entry_rows, 0::BIGINT AS unlisted_rows
FROM ids JOIN records USING (term) LEFT JOIN told USING (term) WHERE n_rows > 0""")
def p3_term_totals(spark, d):
    return eager.term_totals(_postings(spark, d), _entries(spark, d))


@_query("""
SELECT p.term, count(*) AS joined_rows, sum(e.postings_count)::BIGINT AS sum_count
FROM term_postings p JOIN sstable_dict_entry e ON p.term = e.term GROUP BY p.term""")
def p3_join_sums(spark, d):
    return eager.join_sums(_postings(spark, d), _entries(spark, d))
