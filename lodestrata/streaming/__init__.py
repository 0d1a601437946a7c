"""Dumps that arrive one after another."""
