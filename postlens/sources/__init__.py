"""sources of postlens."""
