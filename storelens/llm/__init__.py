"""Operators for training-data pipelines (tokens, dedup, sharding, licences, language, quality, mixing, chat, HTML).

Nothing else in the library imports this package; general helpers (lineage
cuts, shared paths) come from ``storelens.session``.
"""
