"""All queries over the standard tables and their SQL twins."""

from __future__ import annotations

from loomgrid.plans import files as _files  # noqa: F401  registers its queries
from loomgrid.plans import formats as _formats  # noqa: F401  registers its queries
from loomgrid.plans import grid as _grid  # noqa: F401  registers its queries
from loomgrid.plans import lists as _lists  # noqa: F401  registers its queries
from loomgrid.plans import more as _more  # noqa: F401  registers its queries
from loomgrid.plans import palette as _palette  # noqa: F401  registers its queries
from loomgrid.plans import registry
from loomgrid.plans import relational as _relational  # noqa: F401  registers its queries
from loomgrid.plans import stateful as _stateful  # noqa: F401  registers its queries
from loomgrid.plans import streams as _streams  # noqa: F401  registers its queries
from loomgrid.plans import vision as _vision  # noqa: F401  registers its queries

FLAGSHIP = "a6_daily_usage"


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
