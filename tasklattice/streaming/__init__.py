"""Capture and replay of arriving data."""
