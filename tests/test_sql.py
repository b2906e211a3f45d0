import pytest
from pyspark.errors import AnalysisException, ParseException

from tokensift import BindError
from tokensift.operators.catalog import TokenEngine
from tokensift.plans.sql import TokenSQL


@pytest.fixture(scope="module")
def front(spark):
    engine = TokenEngine(spark)
    engine.register("logs", spark.createDataFrame([(0, "Alice met bob", None), (1, None, "alice"), (2, "bob", "x"), (3, "", "")], "id int, msg string, note string"), "id")
    return TokenSQL(engine)


@pytest.mark.parametrize("sql,ids", [
    ("SELECT id FROM logs WHERE contains_token(msg, 'ALICE')", [0]),
    ("SELECT id FROM logs WHERE contains_token(msg, concat('bo', 'b'))", [0, 2]),
    ("SELECT id FROM logs WHERE NOT contains_token(msg, 'alice')", [2, 3]),
    ("SELECT id FROM logs WHERE contains_token(msg, '')", [0, 2, 3]),
    ("SELECT id FROM logs WHERE contains_all_tokens(msg, array('bob', 'ALICE'))", [0]),
    ("SELECT id FROM logs WHERE contains_all_tokens(msg, array())", [0, 2, 3]),
    ("SELECT id FROM logs WHERE contains_any_tokens(msg, array())", []),
    ("SELECT id FROM logs WHERE contains_all_tokens(msg, '[alice, bob]')", [0]),
    ("SELECT id FROM logs WHERE contains_any_tokens(note, array('alice', 'zzz')) OR contains_token(msg, 'bob')", [0, 1, 2]),
    ("WITH c AS (SELECT * FROM logs WHERE contains_token(msg, 'bob')) SELECT id FROM c", [0, 2]),
    ("SELECT id FROM logs WHERE id IN (SELECT id FROM logs WHERE contains_token(msg, 'bob'))", [0, 2]),
    ("SELECT id FROM logs WHERE contains_token(NULL, 'a b')", []), ("SELECT id FROM logs WHERE contains_token(NULL, 'a')", []), ("SELECT id FROM logs WHERE contains_token(msg, CAST(NULL AS STRING))", []),
    ("SELECT id FROM logs WHERE contains_token(concat(msg, ' ', CASE WHEN contains_token(msg, 'met') THEN 'yes' ELSE 'no' END), 'yes')", [0]),
    ("SELECT id /* contains_token(msg, 'x y') */ FROM logs -- '[a, b]'\nWHERE contains_any_tokens(msg, '[zzz, MET]')", [0]),
    ("SELECT id FROM logs WHERE contains_token((SELECT max(msg) FROM logs), 'bob') AND id < 2", [0, 1]),
    ("SELECT id FROM logs WHERE contains_any_tokens(msg, array('1','2','3','4','5','6','7','8','9','BOB'))", [0, 2]),
    ("SELECT id FROM logs WHERE contains_all_tokens(msg, array('1','2','3','4','5','6','7','8','9','bob'))", []),
])
def test_queries(front, sql, ids):
    assert sorted(r.id for r in front.sql(sql).collect()) == ids


@pytest.mark.parametrize("sql", [
    "SELECT contains_token(msg, 'two words') FROM logs", "SELECT contains_token(msg, note) FROM logs", "SELECT contains_token(msg, ?) FROM logs", "SELECT contains_token(msg, :p) FROM logs",
    "SELECT id FROM logs WHERE false AND contains_token(msg, 'a b')", "SELECT id FROM logs WHERE true OR contains_token(msg, 'a b')", "SELECT contains_all_tokens(msg, array('a', NULL)) FROM logs",
    "SELECT contains_all_tokens(msg, array(42)) FROM logs", "SELECT contains_any_tokens(msg, 'alice') FROM logs", "SELECT contains_token(msg, 'café') FROM logs", "SELECT contains_token(msg, array('a')) FROM logs",
    "WITH c AS (SELECT contains_token(msg, 'a b') AS x FROM logs) SELECT 1", "SELECT 1 WHERE EXISTS (SELECT 1 FROM logs WHERE contains_token(msg, 'a b'))",
    "CREATE TEMPORARY VIEW v AS SELECT contains_token(msg, 'a b') FROM logs", "SELECT count(*) FILTER (WHERE contains_token(msg, 'a b')) FROM logs",
    "SELECT l.id FROM logs l LEFT JOIN logs r ON contains_token(l.msg, r.note)",
])
def test_bad_arguments(front, sql):
    with pytest.raises(BindError):
        front.sql(sql)


def test_tokens_of_any_characters(spark):
    marks = ["a'b", 'q"q', "back\\slash", "${x}", "a.b*", "%_", "--c", "/*"]
    engine = TokenEngine(spark)
    engine.register("marks", spark.createDataFrame([(i, f"x {m} y") for i, m in enumerate(marks)], "id int, msg string"), "id")
    front = TokenSQL(engine)
    for i, m in enumerate(marks):
        quoted = "CAST(X'" + m.encode().hex() + "' AS STRING)"
        assert [r.id for r in front.sql(f"SELECT id FROM marks WHERE contains_token(msg, {quoted})").collect()] == [i]


def test_calls_are_written_out(front):
    plan = front.sql("SELECT id FROM logs WHERE contains_token(msg, 'bob') AND contains_all_tokens(msg, array('bob', 'alice'))")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "RLIKE" in plan


def test_listing_in_sql(front):
    front.sql("CREATE INDEX seen ON logs USING tokens (msg)")
    for source in ("token_indexes", "duckdb_indexes()"):
        assert [tuple(r) for r in front.sql(f"SELECT index_name, table_name, is_unique FROM {source} WHERE table_name = 'logs'").collect()] == [("seen", "logs", False)]
    front.sql("DROP INDEX seen")
    assert front.sql("SELECT count(*) AS n FROM duckdb_indexes()").first().n == 0
    with pytest.raises(BindError):
        front.sql("CREATE INDEX seen ON logs USING btree (msg)")


def test_tables_from_sql(front, tmp_path):
    front.sql(f"CREATE TABLE kept_rows USING parquet LOCATION '{tmp_path}/hits' AS SELECT id, contains_token(msg, 'bob') AS hit FROM logs")
    front.sql("INSERT INTO kept_rows SELECT id + 10, contains_token(note, 'alice') FROM logs WHERE contains_token(note, 'alice')")
    assert sorted(map(tuple, front.sql("SELECT * FROM kept_rows").collect())) == [(0, True), (1, None), (2, True), (3, False), (11, True)]
    ordered = front.sql("SELECT contains_token(msg, 'bob') AS hit, count(*) AS n FROM logs GROUP BY contains_token(msg, 'bob') ORDER BY hit NULLS LAST")
    assert [tuple(r) for r in ordered.collect()] == [(False, 1), (True, 2), (None, 1)]
    front.sql("DROP TABLE kept_rows")


def test_arity_and_syntax(front):
    with pytest.raises(AnalysisException):
        front.sql("SELECT contains_token(msg) FROM logs").collect()
    with pytest.raises(ParseException):
        front.sql("SELEC 1")


def test_index_statements(front):
    assert front.sql("CREATE INDEX i ON logs USING tokens (msg)").count() == 1
    assert front.sql('create index if not exists "i" on logs (msg);').count() == 1
    for sql in ("CREATE INDEX i ON logs (msg)", "CREATE UNIQUE INDEX j ON logs (msg)", "CREATE INDEX j ON logs (lower(msg))", "CREATE INDEX j ON logs (msg) WITH (speed = 3)", "CREATE INDEX j ON logs (id)", "DROP INDEX j"):
        with pytest.raises(BindError):
            front.sql(sql)
    with pytest.raises(NotImplementedError):
        front.sql("CREATE INDEX j ON logs (msg, note)")
    assert front.sql("DROP INDEX IF EXISTS j").count() == 1
    assert front.sql("DROP INDEX i").count() == 0
