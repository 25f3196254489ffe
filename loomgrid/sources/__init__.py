"""Readers of pictures, charts, thread lists and dither tables."""
