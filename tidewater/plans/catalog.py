"""Imports every query module so that all queries are registered."""

from tidewater.plans import (  # noqa: F401
    q_backtest, q_calendar, q_evaluate, q_features, q_files, q_learn, q_models, q_more, q_panel, q_prep, q_profile, q_reports, q_series, q_sources,
    q_scale, q_stream,
)
