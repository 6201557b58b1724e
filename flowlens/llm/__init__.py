"""Operators of a training-data pipeline (quality, dedup, language, secrets, tokens, packing)."""
