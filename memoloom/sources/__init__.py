"""Readers and writers, and parsers over frames of (path, text)."""
