"""Readers, parsers of text formats, and writers."""
