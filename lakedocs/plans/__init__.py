"""Compositions: search, reports, and the registered queries."""
