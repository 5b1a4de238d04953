"""Streams of words against rules."""
