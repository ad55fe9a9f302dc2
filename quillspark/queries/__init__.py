"""Queries of the engine, each with the SQL that states its result where SQL can."""

from . import extension, samples, streams, views

MODULES = (samples, views, extension, streams)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
