"""Column functions: each takes and returns Columns and needs no session."""
