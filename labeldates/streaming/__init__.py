"""Streams of label texts."""
