"""Operators over collections: aggregates, relations, mutations."""
