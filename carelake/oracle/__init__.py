"""Independent SQL oracles (DuckDB dialect) for every registered query.

``FIXTURE_CTES`` re-derives the curated facts from the driver's tables exactly as
``carelake.sources.fixtures`` does; each oracle is ``WITH <fixtures>, <own ctes> SELECT``.
"""
