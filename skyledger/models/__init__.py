"""Training, scoring and diagnostics."""
