"""Column functions (native) and matrix functions (numeric)."""
