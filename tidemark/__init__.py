"""A time-versioned analytics engine on PySpark."""
