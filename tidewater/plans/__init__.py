"""Registered plans: logical inputs derived from the driver tables and the
query catalog used by ``__spark_entry__``."""
