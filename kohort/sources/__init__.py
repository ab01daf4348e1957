"""Readers, schema normalisation and sinks."""
