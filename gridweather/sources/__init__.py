"""Readers, sinks and the views over the shared tables."""
