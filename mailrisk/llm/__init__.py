"""Operators of a training-data pipeline: scoring, dedup, decontamination, packing, sharding, extraction."""
