"""Registered queries over the test tables and the SQL each is compared with."""

from prepspark.catalog.base import ORACLES, QUERIES
from prepspark.catalog import cleaning, exploring, features, flows, profiling, runs, sampling, sources  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
