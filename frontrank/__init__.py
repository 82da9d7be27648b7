"""Ranking and evaluation of candidates inside Pareto fronts, as Spark jobs."""
