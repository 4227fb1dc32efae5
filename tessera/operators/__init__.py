"""Operators: metrics, sampling, scheduling, positions, scoring, constraints."""
