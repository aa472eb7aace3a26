"""Every registered query with its SQL oracle, gathered from the topic modules."""

from __future__ import annotations

from tagloom.plans import event_queries, graph_queries, inventory_queries, ml_queries, plant_queries, register_queries, rule_queries

MODULES = (register_queries, graph_queries, event_queries, inventory_queries, rule_queries, plant_queries, ml_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
