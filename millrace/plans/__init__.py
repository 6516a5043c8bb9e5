"""Ordered lists of steps, replayed on any table."""
