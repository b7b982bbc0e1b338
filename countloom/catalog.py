"""All registered queries outside the llm folder."""

from .plans import audits, contracts, files, flagship, intervals, learning, profiles, ranking, regions, reports, selections, sequences, sites, strata, studies, tokens, windows  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
