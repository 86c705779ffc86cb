"""Shared building blocks: column typing, one-pass statistics, rank cuts, lookups."""
