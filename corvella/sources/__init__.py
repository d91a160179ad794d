"""Stored collections, backup archives, migration and sync."""
