"""Queries over the test tables, each with its equivalent SQL."""
