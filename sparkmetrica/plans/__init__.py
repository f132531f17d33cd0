"""Registered queries over the test tables, each with its SQL oracle where SQL can express it."""

from sparkmetrica.plans import arrays, certified, classifiers, collected, eda, experiments, hypotheses, regressions, tuned  # noqa: F401
from sparkmetrica.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
