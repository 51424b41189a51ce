"""Column functions: geometry, numbers as text, and text parsing."""
