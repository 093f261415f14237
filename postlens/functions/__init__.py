"""functions of postlens."""
