"""Column functions (native) and array functions (numpy, for Arrow batches)."""
