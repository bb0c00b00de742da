"""Ready-made queries over the standard tables and their SQL twins."""
