"""Readers and writers for sequence files and tables."""
