"""Training-data operators: dedup, filtering, mixing and tokenisation at corpus scale.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
