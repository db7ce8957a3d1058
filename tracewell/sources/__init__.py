"""Readers and checked writers."""
