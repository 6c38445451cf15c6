"""Schemas, readers, inline series and writers."""
