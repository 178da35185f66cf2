"""Column functions and Arrow kernels shared by the operators."""
