"""tokensift: boolean token search over log text, and corpus-scale term operators, on PySpark."""

from tokensift.errors import BindError, TokenSiftError, UnsupportedError
from tokensift.functions.analyzer import analyze, is_ascii
from tokensift.functions.predicates import contains_all_tokens, contains_any_tokens, contains_token

__all__ = [
    "BindError", "TokenSiftError", "UnsupportedError",
    "analyze", "is_ascii",
    "contains_token", "contains_all_tokens", "contains_any_tokens",
]
