"""A PDF reader and writer in plain Python and numpy, for use inside tasks."""
