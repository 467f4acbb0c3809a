"""Column-expression helpers (no Python UDFs): IP predicates, domain features, text."""
