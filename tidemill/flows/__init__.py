"""End-to-end business flows built from the operators."""
