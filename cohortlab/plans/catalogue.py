"""All registered queries (importing a module registers its queries)."""

from cohortlab.plans import (  # noqa: F401
    queries_cohort, queries_jobs, queries_load, queries_recommend, queries_text, queries_work,
)
from cohortlab.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
