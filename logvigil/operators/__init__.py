"""DataFrame-to-DataFrame operators of an investigation."""
