"""Relational operators of the flow pipeline (DataFrame in, DataFrame out)."""
