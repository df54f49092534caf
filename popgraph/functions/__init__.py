"""Column functions, fixed dimensions, and small numeric helpers."""
