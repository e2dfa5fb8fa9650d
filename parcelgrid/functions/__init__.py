"""Column expressions that stay inside Catalyst."""
