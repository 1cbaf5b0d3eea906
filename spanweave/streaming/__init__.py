"""Session state over streams of queries."""
