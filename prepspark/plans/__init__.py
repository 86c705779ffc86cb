"""Compositions of operators into whole preparation runs."""
