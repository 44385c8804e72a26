"""Column expressions and array kernels on page rasters."""
