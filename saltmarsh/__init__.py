"""Saltmarsh: a PySpark engine for finding, arbitrating and redacting sensitive text at scale."""
