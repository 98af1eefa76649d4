"""Column-level functions: emptiness, tokens, text segmentation, nested paths."""
