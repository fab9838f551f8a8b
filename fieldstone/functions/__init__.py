"""Column functions: ids, normal forms, metrics."""
