"""Column functions and per-batch kernels."""
