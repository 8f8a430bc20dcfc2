"""Column expressions, row frames and array kernels."""
