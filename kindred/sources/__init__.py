"""Readers, writers and line parsers."""
