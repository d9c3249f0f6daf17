"""Queries that bind the operators to tables."""
