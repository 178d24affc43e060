"""Structured Streaming re-aims of the incremental landing (survey ST01-ST07)."""
