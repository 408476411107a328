"""tracewell: a PySpark-native engine for diagnostics evidence and training text."""
