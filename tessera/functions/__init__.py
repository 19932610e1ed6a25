"""Column builders: vector algebra, special functions, tokens, reproducible draws."""
