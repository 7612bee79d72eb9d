"""Relational operators on listing tables."""
