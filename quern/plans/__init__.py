"""Helpers that shape a plan: stage tables, salting, components."""
