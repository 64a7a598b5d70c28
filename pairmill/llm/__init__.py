"""Operators a training-data pipeline adds to the library. Nothing outside imports this package."""
