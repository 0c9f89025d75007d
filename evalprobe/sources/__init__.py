"""Readers, cleaning, stores and sinks."""
