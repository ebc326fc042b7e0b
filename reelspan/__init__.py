"""Timed transcripts and clip timelines as Spark tables."""
