"""Readers: file trees, file contents and metadata, manifests and decision files."""
