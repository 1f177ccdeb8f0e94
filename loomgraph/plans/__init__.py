"""The registered queries over the driver's tables and their SQL."""

from . import evidence, graph, scalars, texts, worlds
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = graph.FLAGSHIP
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "evidence", "graph", "scalars", "texts", "worlds"]
