"""The operators as queries over the given tables: QUERIES by name, ORACLE_SQL where SQL can express them."""

from frontrank.plans import comparing, learning, more, profiling, ranking, whole
from frontrank.plans.ranking import flagship
from frontrank.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "comparing", "flagship", "learning", "more", "profiling", "ranking", "whole"]
