"""Column functions: text, tokens and vectors."""
