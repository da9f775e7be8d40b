"""Readers: each gives a DataFrame."""
