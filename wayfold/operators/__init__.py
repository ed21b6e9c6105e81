"""DataFrame operators, one module per concern."""
