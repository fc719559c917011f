"""Sinks of the card-risk library."""
