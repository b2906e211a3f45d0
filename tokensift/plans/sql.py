"""SQL with token predicates and index statements.

Every statement is parsed first and the calls in it are checked, as the optimizer may fold one away before anyone looks at
its argument: the query argument must be a constant of the right type and make a valid query.  Then each call is written
out in its place for the constant that it has, so that it runs like the column expression.  Calls with a null argument, or
whose text is not a mere value (random, a subquery), are left to SQL functions of the session.  Statements about indexes go
to the catalogue, which can be read as the table ``token_indexes`` or by ``duckdb_indexes()``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from tokensift.errors import BindError
from tokensift.functions.analyzer import NON_ASCII, SEPARATORS
from tokensift.functions.predicates import predicate_sql, query_term, query_terms
from tokensift.operators.catalog import TokenEngine

#: The index type of ``CREATE INDEX .. USING``.
INDEX_TYPE = "tokens"
LISTING = "token_indexes"
FUNCTIONS = ("contains_token", "contains_all_tokens", "contains_any_tokens")
_PART = r'(?:"(?P<{0}q>[^"]+)"|`(?P<{0}b>[^`]+)`|(?P<{0}>\w+))'
_CREATE = re.compile(
    r"\s*CREATE\s+(?P<unique>UNIQUE\s+)?INDEX\s+(?P<missing>IF\s+NOT\s+EXISTS\s+)?" + _PART.format("name") + r"\s+ON\s+" + _PART.format("table")
    + r"\s+(?:USING\s+(?P<type>\w+)\s*)?\((?P<keys>.*?)\)\s*(?:WITH\s*\((?P<options>.*)\))?\s*;?\s*\Z", re.I | re.S)
_DROP = re.compile(r"\s*DROP\s+INDEX\s+(?P<exists>IF\s+EXISTS\s+)?" + _PART.format("name") + r"\s*;?\s*\Z", re.I)
_NAME = re.compile(r'\s*(?:"([^"]+)"|`([^`]+)`|(\w+))\s*\Z')


def _quoted(text: str) -> str:
    return "r'" + text + "'"


def _bodies() -> dict[str, str]:
    def terms(x: str) -> str:
        return f"filter(split(lower({x}), {_quoted(SEPARATORS)}), t -> t <> '')"

    def guarded(argument: str, test: str) -> str:
        return f"""CASE WHEN string IS NULL OR {argument} IS NULL THEN NULL
            WHEN NOT (string RLIKE {_quoted(chr(92) + "A[" + chr(92) + "x00-" + chr(92) + "x7F]*" + chr(92) + "z")}) THEN raise_error('{NON_ASCII}') ELSE {test} END"""

    each = f"forall({terms('q')}, s -> array_contains({terms('string')}, s))"
    return {
        "contains_token(string STRING, token STRING)": guarded("token", f"forall({terms('token')}, s -> array_contains({terms('string')}, s))"),
        "contains_all_tokens(string STRING, tokens ARRAY<STRING>)": guarded("tokens", f"forall(tokens, q -> {each})"),
        "contains_any_tokens(string STRING, tokens ARRAY<STRING>)": guarded("tokens", f"exists(tokens, q -> {each})"),
    }


class TokenSQL:
    """Runs SQL over the tables and indexes of an engine."""

    def __init__(self, engine: TokenEngine):
        self.engine, self.spark = engine, engine.spark
        for signature, body in _bodies().items():
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS BOOLEAN RETURN {body}")

    def sql(self, text: str) -> DataFrame:
        """The result of one statement."""
        if m := _CREATE.match(text):
            return self._create(m)
        if m := _DROP.match(text):
            self.engine.drop_index(self._name(m, "name"), if_exists=bool(m["exists"]))
            return self.engine.indexes()
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        calls, listings = _calls(plan)
        edits = [(*at, LISTING) for at in listings]
        for call in calls:
            value = self._checked(call)
            if value is not None and call.at and call.arguments[0].at and not _NOT_A_VALUE.search(call.arguments[0].sql):
                edits.append((*call.at, (call, value)))
        if LISTING in text.lower() or listings:
            self.engine.indexes().createOrReplaceTempView(LISTING)
        return self.spark.sql(_edited(text, 0, len(text), edits))

    @staticmethod
    def _name(m: re.Match, part: str) -> str:
        return m[part + "q"] or m[part + "b"] or m[part]

    def _create(self, m: re.Match) -> DataFrame:
        if m["type"] and m["type"].lower() != INDEX_TYPE:
            raise BindError(f"there is no index type {m['type']!r}; the type is {INDEX_TYPE!r}")
        names = []
        for key in re.split(r",(?![^()]*\))", m["keys"]):
            found = _NAME.match(key)
            if not found:
                raise BindError(f"an index is built on a column, not on the expression {key.strip()!r}")
            names.append(next(filter(None, found.groups())))
        options = {}
        for option in filter(None, map(str.strip, re.split(r",(?![^()]*\))", m["options"] or ""))):
            options[option.partition("=")[0].strip().strip("'\"`")] = option.partition("=")[2].strip()
        if options:
            raise BindError(f"a token index takes no options; {next(iter(options))!r} was given")
        self.engine.create_index(self._name(m, "name"), self._name(m, "table"), names if len(names) != 1 else names[0], if_not_exists=bool(m["missing"]), unique=bool(m["unique"]))
        return self.engine.indexes()

    def _checked(self, call: Call):
        """The constant of a call; None where the call is left as it stands."""
        name = call.name
        if len(call.arguments) != 2:
            return None  # Spark reports the arity
        if "NULL" in (a.sql.strip().upper() for a in call.arguments):
            return None  # a literal NULL decides before the other argument is looked at
        query = call.arguments[1].sql
        if m := _PLAIN_STRING.fullmatch(query):
            kind, value = "string", m[1]
        elif m := _PLAIN_LIST.fullmatch(query):
            kind, value = "array<string>", re.findall(r"'([^']*)'", m[1])
        else:
            kind, value = self._evaluated(name, query)
        if value is None:
            return None
        if name == "contains_token":
            if kind != "string":
                raise BindError(f"{name} takes a string, not {kind}")
            query_term(name, value)
        else:
            if kind == "string":
                value = _bracketed(value)
            elif kind not in ("array<string>", "array<void>"):
                raise BindError(f"{name} takes a list of strings, not {kind}")
            query_terms(name, value)
        return value

    def _evaluated(self, name: str, query: str):
        """Type and value of a constant expression."""
        if re.search(r"\b(?:pos|named)parameter\(", query):
            raise BindError(f"{name} only takes a constant as its second argument, not a parameter")
        try:
            row = self.spark.sql(f"SELECT {query} AS q")
        except AnalysisException as e:
            if "UNRESOLVED" in (e.getCondition() or ""):
                raise BindError(f"{name} only takes a constant as its second argument, not {query}") from None
            raise
        return row.schema[0].dataType.simpleString(), row.first()[0]


@dataclass(frozen=True)
class Part:
    """An argument: its SQL, and where it stands in the statement."""

    sql: str
    at: tuple[int, int] | None


@dataclass(frozen=True)
class Call:
    name: str
    arguments: list[Part]
    at: tuple[int, int] | None


_PLAIN_STRING = re.compile(r"'([^'\\$]*)'")
_PLAIN_LIST = re.compile(r"array\((\s*'[^'\\$]*'(?:\s*,\s*'[^'\\$]*')*\s*)\)", re.I)
_NOT_A_VALUE = re.compile(r"\b(?:rand|randn|random|uuid|shuffle|monotonically_increasing_id|scalarsubquery|exists|inquery|listquery|pos|namedparameter|posparameter)\(", re.I)


def _edited(text: str, start: int, stop: int, edits: list) -> str:
    """``text[start:stop]`` with the outermost edits in it made; a call's own argument is edited in turn."""
    out, at = [], start
    inside = sorted((e for e in edits if start <= e[0] and e[1] <= stop), key=lambda e: (e[0], -e[1]))
    for low, high, new in inside:
        if low < at:
            continue  # within the last one
        if not isinstance(new, str):
            call, value = new
            own = call.arguments[0].at
            new = predicate_sql(call.name, f"({_edited(text, *own, [e for e in edits if e[:2] != (low, high)])})", value)
        out += [text[at:low], new]
        at = high
    return "".join([*out, text[at:stop]])


def _bracketed(text: str) -> list[str]:
    inner = text.strip()
    if not (inner.startswith("[") and inner.endswith("]")):
        raise BindError(f"{text!r} cannot be converted to a list of strings")
    return [x.strip() for x in inner[1:-1].split(",")] if inner[1:-1].strip() else []


def _each(scala_seq):
    at = scala_seq.iterator()
    while at.hasNext():
        yield at.next()


def _calls(plan) -> tuple[list[Call], list[tuple[int, int]]]:
    """Every call of a token predicate in a parsed plan, wherever it stands, and where the listing of indexes is called."""
    found: list[Call] = []
    listings: list[tuple[int, int]] = []

    def place(e) -> tuple[int, int] | None:
        o = e.origin()
        return (o.startIndex().get(), o.stopIndex().get() + 1) if o.startIndex().isDefined() and o.stopIndex().isDefined() else None

    def expression(e) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = list(_each(e.nameParts()))[-1].lower()
            if name in FUNCTIONS:
                found.append(Call(name, [Part(a.sql(), place(a)) for a in _each(e.arguments())], place(e)))
        if "plan" in dir(e):
            node(e.plan())
        for c in _each(e.children()):
            expression(c)

    def node(p) -> None:
        if p.getClass().getSimpleName() == "UnresolvedTableValuedFunction" and list(_each(p.name()))[-1].lower() == "duckdb_indexes":
            listings.append(place(p))
        for e in _each(p.expressions()):
            expression(e)
        for c in _each(p.children()):
            node(c)
        for c in _each(p.innerChildren()):
            if "expressions" in dir(c):
                node(c)

    node(plan)
    return found, listings
