"""All registered queries; importing the modules fills the registry."""

from trackgeo.plans import (  # noqa: F401
    q_contracts,
    q_grid,
    q_joins,
    q_learn,
    q_profiles,
    q_series,
    q_stats,
    q_structures,
    q_sweeps,
)
from trackgeo.plans.registry import ORACLES, QUERIES  # noqa: F401
