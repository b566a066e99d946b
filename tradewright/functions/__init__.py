"""Column rules and distributed building blocks shared by the operators."""
