"""Readers, file lists and writers."""
