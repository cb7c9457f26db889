"""Column functions: scalar helpers, rules and text."""
