"""tidewater — keyed time-series panels as Spark DataFrame jobs.

Every public operator takes DataFrames plus column names and returns a
DataFrame.  Order-dependent work is always expressed with windows
partitioned by the series key (``series_id``) so that it distributes over
many series; nothing is collected to the driver except documented
one-row-per-feature results.
"""

from tidewater.session import build_session, checkpoint_dir, read_table

__all__ = ["build_session", "checkpoint_dir", "read_table"]
__version__ = "0.1.0"
