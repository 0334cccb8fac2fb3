"""Schemas, stored tables, files and model connectors."""
