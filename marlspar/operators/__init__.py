"""Column-level semantics of the dialect and the operators that need more than one column expression."""
