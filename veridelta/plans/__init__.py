"""Registered queries, by family."""

from . import differential, extensions, graphs, reports, rules, store, texts  # noqa: F401
