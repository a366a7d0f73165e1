"""User-facing plans: the scanner."""
