"""Structured Streaming jobs; each runs to the end of the available input and stops."""
