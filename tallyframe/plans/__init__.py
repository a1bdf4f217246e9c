"""Whole comparisons, reports and roll-ups composed from the operators."""
