"""operators of postlens."""
