"""End-to-end requests composed from the operators."""
