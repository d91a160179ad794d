"""Column functions: tokens and predicates."""
