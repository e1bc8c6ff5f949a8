"""Registered queries and their SQL."""

from . import catalogue, pages, search, structure  # noqa: F401  (the others register their queries)
