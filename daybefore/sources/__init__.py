"""Readers, the table container, and the keyed store."""
