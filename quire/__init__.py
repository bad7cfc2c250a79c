"""Quire: document-pipeline analytics as DataFrame, SQL and Structured Streaming operations."""
