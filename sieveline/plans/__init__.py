"""Registered queries over the test tables and their SQL."""

from . import records, vectors  # noqa: F401
