"""Test-data views, end-to-end compositions and the registered queries with their SQL twins."""
