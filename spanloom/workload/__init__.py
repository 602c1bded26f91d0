"""Corpora derived from the driver tables, the registered queries and their SQL oracles."""
