"""All registered queries and their SQL, collected from the plan modules."""

from __future__ import annotations

from tapeline.plans import charts, events, evidence, market, more, problems, records, research, signals, study

_MODULES = (problems, signals, market, research, evidence, charts, more, study, events, records)
FLAGSHIP = "ma_bullish"
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
