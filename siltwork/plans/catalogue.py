"""All queries of the engine, each with its SQL oracle where one exists."""

from __future__ import annotations

from siltwork.plans import calls, dossiers, exports, graph, pages, profiles, ranking, relational, sources, stages, streams, texts
from siltwork.plans.registry import ORACLES, QUERIES

FLAGSHIP = "gate_per_source"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "calls", "dossiers", "exports", "graph", "pages", "profiles", "ranking", "relational", "sources", "stages", "streams", "texts"]
