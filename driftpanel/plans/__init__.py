"""Whole-study plans and the query registry with its SQL oracles."""
