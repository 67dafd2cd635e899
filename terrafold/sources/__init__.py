"""Readers and writers, and the views that stand in for the spatial tables."""
