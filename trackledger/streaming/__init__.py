"""Structured Streaming versions of batch operators (an extension)."""
