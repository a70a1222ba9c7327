"""Readers and writers of task tables."""
