"""Column expressions and vectorised sequence kernels."""
