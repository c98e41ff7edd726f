"""Streams of catalog records."""
