"""Every operator as a query on the test tables, with SQL that gives the same rows."""

from plumbscore.catalog import curves, deployment, features, models, scans, streams  # noqa: F401
from plumbscore.catalog.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
