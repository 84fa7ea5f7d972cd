"""Readers of landed feed files, and writers."""
