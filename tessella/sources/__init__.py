"""Readers of landed files, and the parsers they share with the queries."""
