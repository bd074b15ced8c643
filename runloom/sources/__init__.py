"""Readers and writers for the text, JSON and file formats."""
