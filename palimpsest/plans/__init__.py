"""Registered queries: each applies operators to whole tables and has its SQL twin."""

from . import changes, code, curation, delta, stats, tokens  # noqa: F401
