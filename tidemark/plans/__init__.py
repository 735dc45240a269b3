"""From query text to a checked, bound plan."""
