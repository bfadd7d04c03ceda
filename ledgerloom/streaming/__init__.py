"""Structured Streaming forms of the batch operators (an extension: the batch contracts have no streams)."""
