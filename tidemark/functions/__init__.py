"""Unsigned 256-bit arithmetic on columns."""
