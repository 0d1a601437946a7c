"""Shredding of records into tables, and audits of the result."""
