"""Operators over DataFrames: scoring, thresholds, evaluation, sampling, provenance, retrieval, tiers, documents."""
