"""Reports composed from the operators: one DataFrame per card."""
