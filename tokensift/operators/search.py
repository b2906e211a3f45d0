"""Predicates as trees, answered by a scan or by the index with the same result.

The index tells in which row groups a tree may be true; where these are few the scan is narrowed to them, and the predicate
itself decides about their rows.  On the join path the terms of the whole tree are read in one pass and brought together per row group, where the tree is
evaluated by array operations on posting lists; a subtree is a set of rows or, under NOT, the complement of one among the
rows whose text is not null.  The resulting ids meet the table in one semi or anti join, which the optimizer may broadcast
if the ids turn out few.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokensift.errors import BindError
from tokensift.functions import predicates as P
from tokensift.functions.analyzer import is_ascii
from tokensift.operators.index import InvertedIndex


class Predicate:
    """A tree of token predicates; combine with &, | and ~."""

    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Token(Predicate):
    token: str | None


@dataclass(frozen=True)
class AllTokens(Predicate):
    tokens: Sequence[str] | None


@dataclass(frozen=True)
class AnyTokens(Predicate):
    tokens: Sequence[str] | None


@dataclass(frozen=True)
class Where(Predicate):
    """Any other condition on the table."""

    condition: Column


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate


def as_condition(tree: Predicate, text: str, non_ascii: str = "error") -> Column:
    """The tree as a column expression.  Token conditions of one AND on the text are analyzed together."""
    if isinstance(tree, Token):
        return P.contains_token(text, tree.token, non_ascii)
    if isinstance(tree, AllTokens):
        return P.contains_all_tokens(text, tree.tokens, non_ascii)
    if isinstance(tree, AnyTokens):
        return P.contains_any_tokens(text, tree.tokens, non_ascii)
    if isinstance(tree, Where):
        return tree.condition
    if isinstance(tree, Not):
        return ~as_condition(tree.inner, text, non_ascii)
    if isinstance(tree, And):
        if merged := _conjunction(tree):
            return P.contains_all_tokens(text, merged, non_ascii)
        return as_condition(tree.left, text, non_ascii) & as_condition(tree.right, text, non_ascii)
    return as_condition(tree.left, text, non_ascii) | as_condition(tree.right, text, non_ascii)


def _conjunction(tree: Predicate) -> list[str] | None:
    """The tokens of a tree that is one conjunction of tokens."""
    if isinstance(tree, Token):
        return None if tree.token is None else [tree.token]
    if isinstance(tree, AllTokens):
        return None if tree.tokens is None else list(tree.tokens)
    if isinstance(tree, And):
        left, right = _conjunction(tree.left), _conjunction(tree.right)
        return left + right if left is not None and right is not None else None
    return None


class _NeedsScan(Exception):
    pass


def _split(tree: Predicate) -> tuple[list[Predicate], list[Column]]:
    """Conjuncts the index can answer, and other conditions."""
    if isinstance(tree, And):
        a, b = _split(tree.left), _split(tree.right)
        return a[0] + b[0], a[1] + b[1]
    return ([], [tree.condition]) if isinstance(tree, Where) else ([tree], [])


def _terms(tree: Predicate) -> set[str]:
    if isinstance(tree, Token):
        if tree.token is None:
            raise _NeedsScan
        term = P.query_term("contains_token", tree.token)
        return set() if term is None else {term}
    if isinstance(tree, (AllTokens, AnyTokens)):
        if tree.tokens is None:
            raise _NeedsScan
        return set(P.query_terms("contains_all_tokens" if isinstance(tree, AllTokens) else "contains_any_tokens", tree.tokens)[0])
    if isinstance(tree, Not):
        return _terms(tree.inner)
    if isinstance(tree, (And, Or)):
        return _terms(tree.left) | _terms(tree.right)
    raise _NeedsScan


_NONE = "array<bigint>"


def _rows(tree: Predicate, lists: dict[str, Column]) -> tuple[bool, Column]:
    """(True, ids of the matching rows) or (False, ids of all other rows), within a row group."""
    empty = F.array().cast(_NONE)
    if isinstance(tree, Token):
        term = P.query_term("contains_token", tree.token)
        return (False, empty) if term is None else (True, lists[term])
    if isinstance(tree, AllTokens):
        found, _ = P.query_terms("contains_all_tokens", tree.tokens)
        out = None
        for t in found:
            out = lists[t] if out is None else F.array_intersect(out, lists[t])
        return (False, empty) if out is None else (True, out)
    if isinstance(tree, AnyTokens):
        found, vacuous = P.query_terms("contains_any_tokens", tree.tokens)
        if vacuous:
            return False, empty
        out = empty
        for t in found:
            out = F.array_union(out, lists[t])
        return True, out
    if isinstance(tree, Not):
        sign, ids = _rows(tree.inner, lists)
        return not sign, ids
    (sa, a), (sb, b) = _rows(tree.left, lists), _rows(tree.right, lists)
    if isinstance(tree, Or):  # a or b = not (not a and not b)
        sa, sb = not sa, not sb
    if sa and sb:
        sign, ids = True, F.array_intersect(a, b)
    elif not sa and not sb:
        sign, ids = False, F.array_union(a, b)
    else:
        sign, ids = True, F.array_except(a, b) if sa else F.array_except(b, a)
    return (not sign if isinstance(tree, Or) else sign), ids


def matching_ids(index: InvertedIndex, tree: Predicate) -> tuple[bool, DataFrame]:
    """(True, ``row_id`` of the matching rows) or (False, ``row_id`` of the rows with a text that do not match)."""
    terms = sorted(_terms(tree))
    lists = {t: F.coalesce(F.first(F.when(F.col("term") == F.lit(t), F.col("row_ids")), ignorenulls=True), F.array().cast(_NONE)) for t in terms}
    own = {t: F.col(f"t{i}") for i, t in enumerate(terms)}
    sign, ids = _rows(tree, own)
    if not terms:
        return sign, index.table.sparkSession.range(0).select(F.col("id").alias("row_id"))
    grouped = index.table.where(F.col("term").isin(terms)).groupBy("row_group").agg(*(lists[t].alias(f"t{i}") for i, t in enumerate(terms)))
    return sign, grouped.select(F.explode(ids).alias("row_id"))


def _groups(tree: Predicate, known: dict[str, set[int]]) -> set[int] | None:
    """Row groups outside of which ``tree`` is never true; None if it may be true in any."""
    if isinstance(tree, (Token, AllTokens, AnyTokens)):
        if isinstance(tree, Token):
            found = [P.query_term("contains_token", tree.token)]
        else:
            found, vacuous = P.query_terms("contains_any_tokens", tree.tokens)
            if vacuous and isinstance(tree, AnyTokens):
                return None
        sets = [known.get(t) for t in found]
        if isinstance(tree, AnyTokens):
            return None if None in sets else set().union(*sets)
        bounded = [x for x in sets if x is not None]
        return set.intersection(*bounded) if bounded else None
    if isinstance(tree, (And, Or)):
        a, b = _groups(tree.left, known), _groups(tree.right, known)
        if isinstance(tree, And):
            return a if b is None else b if a is None else a & b
        return None if a is None or b is None else a | b
    return None


def _ranges(groups: set[int], most: int) -> list[tuple[int, int]]:
    """Runs of row groups, ends exclusive; where there are more than ``most``, the narrowest gaps are bridged."""
    runs: list[tuple[int, int]] = []
    for g in sorted(groups):
        if runs and runs[-1][1] == g:
            runs[-1] = runs[-1][0], g + 1
        else:
            runs.append((g, g + 1))
    gaps = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1], reverse=True)
    kept = sorted(gaps[: most - 1])
    return [(runs[a][0], runs[b - 1][1]) for a, b in zip([0, *kept], [*kept, len(runs)])] if runs else []


#: The pruned scan is taken for trees that lie in at most so many row groups, and reads so many ranges of them.
MOST_GROUPS, MOST_RANGES = 128, 16


def pruned(table: DataFrame, id_column: str, tree: Predicate, index: InvertedIndex) -> DataFrame | None:
    """The rows of the row groups in which ``tree`` may be true; None where the index rules too little out.

    The ranges of ids are pushed into the scan, which leaves out files, row groups and pages of a table that is laid out by
    row id (``laid_out``).
    """
    groups = _groups(tree, index.groups_of(sorted(_terms(tree)), MOST_GROUPS))
    if groups is None:
        return None
    if not groups:
        return table.where(F.lit(False))
    row_id, size = F.col(id_column), index.row_group_size
    ranges = [(row_id >= F.lit(a * size)) & (row_id < F.lit(b * size)) for a, b in _ranges(groups, MOST_RANGES)]
    return table.where(reduce(or_, ranges))


def _bounded(tree: Predicate) -> bool:
    """Whether the terms of ``tree`` can rule row groups out at all."""
    if isinstance(tree, And):
        return _bounded(tree.left) or _bounded(tree.right)
    if isinstance(tree, Or):
        return _bounded(tree.left) and _bounded(tree.right)
    return isinstance(tree, (Token, AllTokens, AnyTokens))


def search(
    table: DataFrame, id_column: str, text_column: str, tree: Predicate, index: InvertedIndex | None = None,
    non_ascii: str = "error", path: str = "auto",
) -> DataFrame:
    """The rows of ``table`` for which ``tree`` is true.

    ``path``: with ``'auto'`` the index tells the row groups in which the tree may be true.  Where they are few, they alone
    are scanned; else, and for a tree that rules nothing out, such as NOT, the whole table is.  With ``'join'`` the index
    answers the token conditions and the ids meet the table in a semi or anti join, which saves the analysis of texts that
    are long; other conditions joined to them by AND are filters on the result.  A tree that mixes them under OR or NOT, or
    has a null argument, is scanned.  The index must cover the table as it is and have been built with the same
    ``non_ascii``; then all ways give the same rows.
    """
    if path not in ("auto", "join", "scan"):
        raise BindError(f"path must be 'auto', 'join' or 'scan', not {path!r}")
    condition = as_condition(tree, text_column, non_ascii)  # reports bad arguments in any case
    if index is None or path == "scan":
        return table.where(condition)
    try:
        parts, conditions = _split(tree)
        if not parts:
            raise _NeedsScan
        whole = reduce(And, parts)
        if path == "auto":
            few = pruned(table, id_column, whole, index) if _bounded(whole) else None
            return (table if few is None else few).where(condition)
        sign, ids = matching_ids(index, whole)
    except _NeedsScan:
        return table.where(condition)
    rows = table
    for c in conditions:
        rows = rows.where(c)
    ids = ids.select(F.col("row_id").alias("__row_id"))
    match = F.col(id_column).cast("bigint") == F.col("__row_id")
    if sign:
        return rows.join(ids, match, "left_semi")
    text = F.col(text_column)
    present = text.isNotNull() if non_ascii == "error" else is_ascii(text)
    return rows.where(present).join(ids, match, "left_anti")
