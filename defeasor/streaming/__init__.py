"""Evidence as a stream."""
