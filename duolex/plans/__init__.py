"""End-to-end recipes composed from the operators."""
