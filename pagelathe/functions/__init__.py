"""Kernels without Spark, and the column functions made of them."""
