"""Scans, decoders, schema contracts and sinks."""
