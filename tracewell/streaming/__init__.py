"""Operators over unbounded event streams."""
