"""Column helpers: expressions that several operators share."""

from frontrank.functions.columns import *  # noqa: F403
