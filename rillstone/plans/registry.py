"""All queries of the core, by name."""

from __future__ import annotations

from . import analytic, relational, telemetry, timed

_PARTS = (relational, timed, analytic, telemetry)
QUERIES = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _PARTS for k, v in m.ORACLES.items()}
