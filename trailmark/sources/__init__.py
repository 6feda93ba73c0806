"""Readers and adapters to the canonical tables."""
