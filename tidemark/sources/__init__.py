"""Tables from packed words, cells and rows."""
