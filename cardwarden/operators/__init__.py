"""Operators of the card-risk library."""
