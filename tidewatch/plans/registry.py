"""All queries of the general operators."""

from __future__ import annotations

from tidewatch.plans import monitor, problems, review, text

MODULES = [problems, monitor, text, review]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
FLAGSHIP = "causal_poisson_alerts"
