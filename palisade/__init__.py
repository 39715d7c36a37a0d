"""Palisade: request-security analytics on PySpark."""
