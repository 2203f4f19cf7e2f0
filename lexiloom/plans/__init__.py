

from . import boundaries, corpus  # noqa: F401  add their queries
