"""Readers, writers and dimension tables."""
