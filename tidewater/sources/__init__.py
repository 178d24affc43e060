"""Readers, parsers and sinks (survey S01-S14, P01-P02)."""
