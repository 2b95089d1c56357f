"""Importing this package fills the query catalogue."""

from flowquarry.plans import alerting, checks, detection, flows, models, monitoring, packets, prepare, scoring, sources, streams  # noqa: F401
from flowquarry.plans.registry import CATALOGUE  # noqa: F401
