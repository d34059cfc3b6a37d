"""Readers, writers, declared schemas and the staged tables."""
