"""Column expressions and fixed lookup values shared by the operators."""
