"""World views, registered queries and their SQL."""

from . import classes, events, movables, places, queries, records, scalars, scripts, solids  # noqa: F401 (each registers its queries)
