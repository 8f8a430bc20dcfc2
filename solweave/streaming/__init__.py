"""Append path for solutions that arrive as a stream."""
