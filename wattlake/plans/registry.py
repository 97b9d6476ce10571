"""All registered queries of the regional engine and their SQL."""

from wattlake.plans import networks, regional  # noqa: F401  register their queries
from wattlake.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
