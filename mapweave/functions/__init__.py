"""Column functions: geometry, tag rules, JSON text."""
