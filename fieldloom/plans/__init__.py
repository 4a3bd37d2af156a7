"""Named queries over the driver's tables, each with a DuckDB twin where SQL expresses it."""

from fieldloom.plans import binary, cube, relational, space, streams  # noqa: F401
from fieldloom.plans.base import ORACLES, QUERIES  # noqa: F401
