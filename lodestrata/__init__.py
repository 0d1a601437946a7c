"""Lodestrata: a PySpark-native engine that shreds XML catalogue dumps into typed relational tables."""

__version__ = "0.1.0"
