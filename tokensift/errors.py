"""Errors raised on the driver, before a plan exists."""


class TokenSiftError(Exception):
    """Base of all errors of this package."""


class BindError(TokenSiftError, ValueError):
    """An argument or a DDL request that can never be evaluated."""


class UnsupportedError(TokenSiftError, NotImplementedError):
    """A request whose meaning is clear but which the engine declines."""
