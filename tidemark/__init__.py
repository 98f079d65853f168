"""Tidemark: log, metric and change analytics on Spark."""
