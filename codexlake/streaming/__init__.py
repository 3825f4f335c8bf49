"""Incremental processing: watched folders, append logs, stage state."""
