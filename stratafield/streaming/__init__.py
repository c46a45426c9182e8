"""Checks of points that arrive as a stream."""
