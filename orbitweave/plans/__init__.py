"""Registered queries over the driver's tables."""

from orbitweave.plans import data_queries, derived_queries, geo_queries, io_queries, queue_queries

ALL = queue_queries.QUERIES | geo_queries.QUERIES | data_queries.QUERIES | io_queries.QUERIES | derived_queries.QUERIES
QUERIES = {name: fn for name, (fn, _) in ALL.items()}
ORACLES = {name: sql for name, (_, sql) in ALL.items() if sql}
