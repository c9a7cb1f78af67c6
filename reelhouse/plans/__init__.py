"""Whole plans over a library."""
