"""Relational operators over manifests."""
