"""Sources of the card-risk library."""
