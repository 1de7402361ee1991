"""DataFrame operators on long-form tables."""
