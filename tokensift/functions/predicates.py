"""Token predicates: boolean retrieval with constant query arguments and SQL's three-valued logic.

All checks of the query argument happen when the predicate is built, so a bad argument is reported wherever the predicate
stands, even where the optimizer would never evaluate it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokensift.errors import BindError
from tokensift.functions.analyzer import NON_ASCII, SEPARATORS, analyze_literal, as_column, guarded, has_term, pieces, term_pattern


#: Up to so many terms are sought one by one.
FEW = 8


def query_term(function: str, token: object) -> str | None:
    """The one term of a token; None for a token that analyzes to nothing."""
    if isinstance(token, Column):
        raise BindError(f"{function}: the query argument must be a constant, not a column")
    if token is None:
        raise BindError(f"{function}: a token list must not have NULL in it")
    if not isinstance(token, str):
        raise BindError(f"{function}: a token must be a string, not {type(token).__name__}")
    found = analyze_literal(token)
    if len(found) > 1:
        raise BindError(f"{function}: {token!r} is {len(found)} tokens; pass them to contains_all_tokens or contains_any_tokens one by one")
    return found[0] if found else None


def query_terms(function: str, tokens: object) -> tuple[list[str], bool]:
    """The distinct terms of a token list in order, and whether a token analyzed to nothing."""
    if isinstance(tokens, Column):
        raise BindError(f"{function}: the query argument must be a constant, not a column")
    if isinstance(tokens, str) or not isinstance(tokens, Sequence):
        raise BindError(f"{function}: the query argument must be a list of strings")
    found = [query_term(function, t) for t in tokens]
    return list(dict.fromkeys(t for t in found if t is not None)), None in found


def _null() -> Column:
    return F.lit(None).cast("boolean")


def _constant(col: Column, value: bool) -> Column:
    return F.when(col.isNotNull(), F.lit(value))


def contains_token(col: str | Column | None, token: str | None, non_ascii: str = "error") -> Column:
    """Whether ``token`` is among the terms of ``col``; null if either is null.

    A token of nothing but white space is contained in every text.
    """
    if col is None or token is None:
        return _null()
    c, term = as_column(col), query_term("contains_token", token)
    test = _constant(c, True) if term is None else has_term(c, term)
    return guarded(c, test, non_ascii)


def contains_all_tokens(col: str | Column | None, tokens: Sequence[str] | None, non_ascii: str = "error") -> Column:
    """Whether every token is among the terms of ``col``; true for an empty list, null if either argument is null.

    Short lists are sought in the text one by one; for longer ones it is analyzed once.
    """
    if col is None or tokens is None:
        return _null()
    c, (found, _) = as_column(col), query_terms("contains_all_tokens", tokens)
    if not found:
        test = _constant(c, True)
    elif len(found) <= FEW:
        test = reduce(and_, (has_term(c, t) for t in found))
    else:
        test = F.when(c.isNotNull(), F.size(F.array_except(F.array(*map(F.lit, found)), pieces(c))) == 0)
    return guarded(c, test, non_ascii)


def contains_any_tokens(col: str | Column | None, tokens: Sequence[str] | None, non_ascii: str = "error") -> Column:
    """Whether some token is among the terms of ``col``; false for an empty list, null if either argument is null."""
    if col is None or tokens is None:
        return _null()
    c, (found, vacuous) = as_column(col), query_terms("contains_any_tokens", tokens)
    if vacuous or not found:
        test = _constant(c, vacuous)
    elif len(found) <= FEW:
        test = reduce(or_, (has_term(c, t) for t in found))
    else:
        test = F.arrays_overlap(pieces(c), F.array(*map(F.lit, found)))
    return guarded(c, test, non_ascii)


# the same predicates as SQL text, for arguments that are written as SQL

def _literal(text: str) -> str:
    """``text`` as a string literal that no setting of the parser reads differently."""
    return f"'{text}'" if re.fullmatch(r"[\w=.:/-]*", text) else f"CAST(X'{text.encode().hex()}' AS STRING)"


def _term_sql(c: str, term: str) -> str:
    return f"(contains(lower({c}), {_literal(term)}) AND lower({c}) RLIKE r'{term_pattern(term)}')"


def predicate_sql(function: str, c: str, value: object, non_ascii: str = "error") -> str:
    """The call of ``function`` on the SQL expression ``c`` with a checked constant, written out."""
    if function == "contains_token":
        term = query_term(function, value)
        found, all_of, empty = ([] if term is None else [term]), True, True
    else:
        found, vacuous = query_terms(function, value)
        all_of = function == "contains_all_tokens"
        empty = True if all_of else vacuous
        if vacuous and not all_of:
            found = []
    if not found:
        test = f"CASE WHEN {c} IS NOT NULL THEN {str(empty).upper()} END"
    elif len(found) <= FEW:
        test = (" AND " if all_of else " OR ").join(_term_sql(c, t) for t in found)
    else:
        own, terms = f"split(lower({c}), r'{SEPARATORS}')", "array(" + ", ".join(map(_literal, found)) + ")"
        test = f"CASE WHEN {c} IS NOT NULL THEN size(array_except({terms}, {own})) = 0 END" if all_of else f"arrays_overlap({own}, {terms})"
    ascii_ = f"(is_valid_utf8({c}) AND octet_length({c}) = char_length({c}))"
    other = f"raise_error('{NON_ASCII}')" if non_ascii == "error" else "NULL"
    return f"(CASE WHEN NOT {ascii_} THEN {other} ELSE ({test}) END)"
