"""Streams are additions here: the surface that this engine covers has none of its own."""
