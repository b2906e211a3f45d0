"""A batch of texts as one array of code points: the common ground of the vectorised text operators."""

from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    """The code points of ``text``; lone surrogates are kept as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def utf8_lengths(points: np.ndarray) -> np.ndarray:
    """Bytes that each code point takes in UTF-8."""
    return (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
