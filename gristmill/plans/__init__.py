"""Named queries over the test tables. Importing this package registers all of them."""

from gristmill.plans.registry import ORACLES, QUERIES
from gristmill.plans import catalog_queries, corpus_queries, digest_queries, feed_queries, io_queries, verify_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
