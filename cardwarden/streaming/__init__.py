"""Streaming of the card-risk library."""
