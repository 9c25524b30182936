"""Scalar kernels as column expressions."""
