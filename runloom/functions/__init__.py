"""Column functions and order-dependent helpers."""
