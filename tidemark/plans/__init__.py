"""Compositions of operators: the full report and the named queries."""
