"""Column functions and Arrow kernels."""
