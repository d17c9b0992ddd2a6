"""Readers and writers for packet, alert, block and device tables."""
