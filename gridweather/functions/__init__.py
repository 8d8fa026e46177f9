"""Column functions: hashing, unit and time arithmetic, feature vectors."""
