"""Column builders: keyed randomness, distances, feature vectors."""
