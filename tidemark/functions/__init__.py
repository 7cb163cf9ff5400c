"""Column functions: calendar arithmetic, identifiers, robust inference, distributions."""
