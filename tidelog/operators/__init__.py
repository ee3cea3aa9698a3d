"""DataFrame operators on the change log."""
