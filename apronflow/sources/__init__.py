"""Schemas, readers, writers and scratch tables."""
