"""Readers of captured board payloads."""
