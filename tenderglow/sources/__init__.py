"""Feeds, pages and files to draft tables."""
