"""Relational operators over videos, timelines and the work queue."""
