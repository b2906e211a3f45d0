"""Token search over streams."""

from tokensift.streaming.search import append_postings, matching, streamed_index, token_counts

__all__ = ["append_postings", "matching", "streamed_index", "token_counts"]
