"""Dump files: which there are, and their records as text."""
