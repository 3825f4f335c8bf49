"""Readers, sinks and the shared scratch area."""
