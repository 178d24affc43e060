"""Column-level helpers (scalar expressions and window specs)."""

from tidewater.functions.scalar import *  # noqa: F401,F403
from tidewater.functions.windows import *  # noqa: F401,F403
