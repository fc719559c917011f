"""Functions of the card-risk library."""
