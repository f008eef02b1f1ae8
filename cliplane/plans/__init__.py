"""Registered queries and multi-operator plans."""
