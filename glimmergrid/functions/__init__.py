"""Column functions: paths, vectors, pixels and model features."""
