"""Entities, their tables and record schemas, and the DDL made from them."""
