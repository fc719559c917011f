"""Plans of the card-risk library."""
