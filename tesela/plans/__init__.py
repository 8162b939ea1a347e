"""Queries of the engine over its input tables; importing the package registers them."""

from tesela.plans import discourse, grammar_plans, lexicon_plans, parts, space_plans, statistics  # noqa: F401
