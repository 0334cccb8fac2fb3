"""Column-to-column functions: text, time, vectors, metrics."""
