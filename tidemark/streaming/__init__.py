"""Epoch commits from streams."""
