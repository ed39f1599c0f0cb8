"""Every query by name, and the same in DuckDB SQL."""

from .operators import queries, vectors  # noqa: F401  (vectors adds its own to queries)
from .plans import star
from .streaming import events

FLAGSHIP = "ssb_q41"
QUERIES: dict = {**star.QUERIES, **queries.QUERIES, **events.QUERIES}
SQL: dict = {**star.SQL, **queries.SQL, **events.SQL}
