"""All named queries. Importing this package registers them."""

from pairmill.registry import corpus, pairs, scalars, shards, streams, training  # noqa: F401
from pairmill.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
