"""Column functions and small per-task helpers."""
