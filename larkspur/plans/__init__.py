"""Backend-neutral plans (filters, sorts, updates) and their compilation to columns."""
