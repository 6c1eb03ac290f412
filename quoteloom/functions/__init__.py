"""Column builders: one module for each family of scalar rules."""
