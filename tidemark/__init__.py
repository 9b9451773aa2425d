"""Tidemark: a PySpark-native analytics engine for code-index, task-board and usage data."""
