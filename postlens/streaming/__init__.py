"""streaming of postlens."""
