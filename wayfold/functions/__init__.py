"""Column functions: text, evidence and cells."""
