"""Readers of pixel, polygon and criterion tables, and stand-ins for tests."""
