"""Playback-log analytics on Spark."""
