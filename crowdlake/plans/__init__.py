"""Registered queries: operators applied to the given tables, each with an independent SQL check."""

from crowdlake.plans.registry import ORACLES, QUERIES  # noqa: F401
from crowdlake.plans import (  # noqa: F401  (importing a module registers its queries)
    fleet_queries,
    forecast_queries,
    frame_queries,
    scalar_queries,
    source_queries,
    temporal_queries,
)
