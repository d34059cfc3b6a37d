"""DataFrame-to-DataFrame operators of the star schema."""
