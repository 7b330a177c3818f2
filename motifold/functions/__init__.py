"""Scalar functions as columns, and what the driver works out once."""
