"""plans of postlens."""
