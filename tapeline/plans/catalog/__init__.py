"""Every registered query with the SQL that checks it."""

from tapeline.plans.catalog import (  # noqa: F401
    averages_and_oscillators, bars_and_features, books, runs, sources_and_sinks, strategies, structures, trading, trends,
)
from tapeline.plans.catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
