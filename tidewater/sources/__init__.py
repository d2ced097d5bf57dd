"""Table registry, readers and writers."""
