"""Part of the plumbline library."""
