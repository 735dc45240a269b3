"""Operators over versioned tables."""
