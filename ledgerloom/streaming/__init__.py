"""Streaming forms of the writes: what a batch run does once, for rows as they come."""
