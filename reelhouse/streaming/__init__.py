"""Continuous versions: files as they arrive, and clicks as they are made."""
