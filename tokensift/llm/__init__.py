"""Operators for training data: term statistics, text forms, token ids, leaks and spam.

Nothing outside this subpackage imports it.
"""
